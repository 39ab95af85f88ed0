"""File sources: CSV, JSON, parquet, mixed object folders, and Excel workbooks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# The file endings an object folder is read for.
MIXED_FORMATS = ("csv", "json")


def _reader(spark: SparkSession, cfg: dict, fmt: str, options: dict[str, str]):
    """A reader; JSON is an object per line, or with ``multi_line`` a document (an object or a list) per
    file. Text that is neither is an error, not a row of blanks."""
    if fmt == "json":
        options = {"multiLine": str(bool(cfg.get("multi_line"))).lower(), "mode": cfg.get("mode", "FAILFAST"), **options}
    reader = spark.read.format(fmt).options(**options)
    return reader.schema(cfg["schema"]) if cfg.get("schema") else reader


def _has(spark: SparkSession, path: str, glob: str) -> bool:
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", "true").load(path).select("path"))
    return bool(listing.take(1))


def read_files(spark: SparkSession, cfg: dict, spec, table: str | None) -> DataFrame:
    path = cfg.get("path")
    if not path:
        raise ValueError(f"source {cfg['type']!r} needs path")
    if spec.format == "mixed":
        return read_mixed(spark, cfg, spec, f"{path.rstrip('/')}/{table}" if table else path)
    if spec.format == "excel":
        return read_excel(spark, path, cfg.get("sheet", table), cfg["schema"])
    if table and not cfg.get("single_file"):
        ending = cfg.get("extension", "")
        path = f"{path.rstrip('/')}/{table}{ending}"
    return _reader(spark, cfg, spec.format, spec.options(cfg, table)).load(path)


def read_mixed(spark: SparkSession, cfg: dict, spec, path: str) -> DataFrame:
    """All CSV and JSON files below a prefix as one frame; other files are passed over.

    Columns that only some formats have are NULL for the others.
    """
    frames = []
    for ending in MIXED_FORMATS:
        glob = f"*.{ending}"
        if _has(spark, path, glob):
            options = spec.options(cfg, None) if ending == "csv" else {}
            frames.append(_reader(spark, cfg, ending, {**options, "pathGlobFilter": glob,
                                                       "recursiveFileLookup": "true"}).load(path))
    if not frames:
        raise ValueError(f"no {' or '.join(MIXED_FORMATS)} files below {path}")
    return union_frames(frames)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name; absent columns are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def list_tables(spark: SparkSession, cfg: dict) -> list[str]:
    """File names without their ending, below the source's path."""
    ending = cfg.get("extension", f".{cfg['type']}")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(cfg["path"])
             .select(F.element_at(F.split("path", "/"), -1).alias("name")))
    # file names of one folder
    return sorted(r.name.removesuffix(ending) for r in found.collect())


def excel_engine() -> str | None:
    """The optional workbook reader, if it is installed."""
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        return None
    return "openpyxl"


def read_excel(spark: SparkSession, path: str, sheet: str | int | None, schema: str | StructType) -> DataFrame:
    """One sheet of every workbook below ``path``, a task per file."""
    if excel_engine() is None:
        raise ImportError("reading workbooks needs the optional package openpyxl")
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = struct.fieldNames()
    which = 0 if sheet is None else sheet

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.read_excel(io.BytesIO(content), sheet_name=which)[names]

    books = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content"))
    return books.mapInPandas(parse, struct)
