"""Keyed write-back: a table in buckets of its key, where a commit rewrites the buckets it touches and a manifest makes it visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quillon.operators.rows import upsert

BUCKETS = 64


class VersionConflict(RuntimeError):
    """Another writer has committed, or is committing, the version that this one would be."""


class KeyedTable:
    """A table below ``path``, in any store that Spark writes to.

    ``data/commit=.../bucket=n`` holds rows of one bucket as one commit wrote them; ``manifests/n.json`` names the folder of
    every bucket in version n. Data folders are never changed, so readers of a version see all of it and nothing else,
    whatever is written meanwhile. A commit is visible once its manifest is; one that fails before leaves the old version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests: a few names per bucket, kept on the driver ---

    def _versions(self, ending: str = ".json") -> list[int]:
        folder = self._hadoop(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(ending)) for n in names if n.endswith(ending))

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._hadoop(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _claim(self, version: int) -> None:
        """Take a version number. Creating the claim fails if it exists, so two writers never have the same."""
        try:
            self._write(f"{self.path}/manifests/{version}.claim", "")
        except Exception as error:
            raise VersionConflict(f"version {version} is being written; if its writer is gone, release({version})") from error
        if self.latest() >= version:
            self.release(version)
            raise VersionConflict(f"version {version} was committed meanwhile")

    def release(self, version: int) -> None:
        """Give up the claim of a writer that is gone. Its data folders are in no manifest."""
        self._fs.delete(self._hadoop(f"{self.path}/manifests/{version}.claim"), False)

    def _publish(self, manifest: dict) -> None:
        """Show a version: the manifest appears under its name whole, by a rename."""
        draft = f"{self.path}/manifests/{uuid.uuid4().hex}.draft"
        self._write(draft, json.dumps(manifest))
        if not self._fs.rename(self._hadoop(draft), self._hadoop(f"{self.path}/manifests/{manifest['version']}.json")):
            raise VersionConflict(f"version {manifest['version']} could not be shown")
        self.release(manifest["version"])

    # --- rows ---

    def _bucket(self, keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int")

    def _store(self, df: DataFrame, keys: list[str], n: int) -> str:
        """Write rows by their buckets; returns the commit's folder."""
        folder = f"{self.path}/data/commit={uuid.uuid4().hex}"
        df.withColumn("__bucket", self._bucket(keys, n)).repartition(n, "__bucket").write.partitionBy("__bucket").parquet(folder)
        return folder

    def _filled(self, folder: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("__bucket="))

    def create(self, df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int:
        """Version 1 from a frame; ``buckets`` stays for good. Rows with a null in a key share a key with their like."""
        if self.latest():
            raise VersionConflict(f"{self.path} holds a table")
        self._claim(1)
        folder = self._store(df, keys, buckets)
        self._publish({"version": 1, "base": 0, "keys": keys, "n": buckets, "schema": df.schema.json(),
                       "buckets": {str(b): folder for b in self._filled(folder)}, "rewritten": self._filled(folder)})
        return 1

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the newest), or of some of its buckets."""
        found = self.manifest(version)
        schema = StructType.fromJson(json.loads(found["schema"]))
        folders = [f"{f}/__bucket={b}" for b, f in found["buckets"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def bucket_of(self, keys_frame: DataFrame) -> list[int]:
        """The buckets that a frame's keys lie in: at most as many as the table has."""
        found = self.manifest()
        return sorted(r[0] for r in keys_frame.select(self._bucket(found["keys"], found["n"])).distinct().collect())

    def _commit(self, base: dict, rows: DataFrame, touched: list[int]) -> int:
        version = base["version"] + 1
        self._claim(version)
        folder = self._store(rows, base["keys"], base["n"])
        filled = set(self._filled(folder))
        buckets = {b: f for b, f in base["buckets"].items() if int(b) not in touched}
        buckets |= {str(b): folder for b in filled}
        self._publish({**base, "version": version, "base": base["version"], "buckets": buckets, "rewritten": touched})
        return version

    def upsert(self, updates: DataFrame, order_by: str | None = None) -> int:
        """A version in which rows are replaced or added by key; the last update of a key by ``order_by`` wins.

        Only buckets with an update are read and written. Raises :class:`VersionConflict` if another writer was faster.
        """
        base = self.manifest()
        touched = self.bucket_of(updates)
        if not touched:
            return base["version"]
        return self._commit(base, upsert(self.read(base["version"], touched), updates, base["keys"], order_by), touched)

    def delete(self, gone: DataFrame) -> int:
        """A version without the rows whose keys ``gone`` has."""
        base = self.manifest()
        touched = self.bucket_of(gone)
        if not touched:
            return base["version"]
        here = self.read(base["version"], touched).alias("h")
        keys = gone.select(*base["keys"]).distinct().alias("g")
        same = F.lit(True)
        for k in base["keys"]:
            same = same & F.col(f"h.`{k}`").eqNullSafe(F.col(f"g.`{k}`"))
        return self._commit(base, here.join(keys, same, "left_anti"), touched)

    def changes(self, old: int, new: int) -> DataFrame:
        """``change`` (added, removed, changed) and the keys between two versions; only buckets that differ are read."""
        a, b = self.manifest(old), self.manifest(new)
        differ = [int(x) for x in {*a["buckets"], *b["buckets"]} if a["buckets"].get(x) != b["buckets"].get(x)]
        keys, rest = a["keys"], [f["name"] for f in json.loads(a["schema"])["fields"] if f["name"] not in a["keys"]]

        def side(version: int, name: str) -> DataFrame:
            rows = self.read(version, differ)
            return rows.select(*[F.col(f"`{k}`") for k in keys], F.xxhash64(*[F.col(f"`{c}`") for c in rest]).alias(name)) if rest \
                else rows.select(*keys, F.lit(0).alias(name))

        x, y = side(old, "old").alias("x"), side(new, "new").alias("y")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`"))
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        both = x.join(y, same, "full_outer").select(
            kind.alias("change"), *[F.coalesce(F.col(f"x.`{k}`"), F.col(f"y.`{k}`")).alias(k) for k in keys])
        return both.where("change IS NOT NULL")
