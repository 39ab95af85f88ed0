"""Written intermediate tables and row keys that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that goes to Python. The 10,000 rows of Spark's default are 35 MB of texts, which an executor holds
#: several times, and whose room neither the JVM's nor Python's allocator gives back.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The table cuts the lineage: what reads it later survives the loss of any executor. Shuffle files of the
    job that wrote it are removed with the job, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with _setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside, such as those of ``written``, send rows to Python in batches of bounded size, all of them. A frame that is run
    later is not bounded."""
    with _setting(spark, *BATCH):
        yield


def with_python(df: DataFrame, inputs: list[str], outputs: dict[str, tuple[str, pa.DataType]],
                function: Callable[..., Iterable[tuple]], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) as they are, and new ones that ``function`` makes from lists of ``inputs``.

    ``outputs`` names the new columns with their Spark and Arrow types; they replace columns of their names.
    ``function`` takes a list per input and returns a tuple per row. Batches come and go as Arrow tables, so the other
    columns, nulls and large whole numbers among them, are never converted.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    schema = df.select(*kept, *[F.lit(None).cast(kind).alias(c) for c, (kind, _) in outputs.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(function(*[batch.column(c).to_pylist() for c in inputs]))
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=[*kept, *outputs])

    return df.select(*dict.fromkeys([*kept, *inputs])).mapInArrow(run, schema)
