"""A log of what was done to each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators.rows import retain_last

ENTRIES_PER_SOURCE = 100


def append_lineage(spark: SparkSession, path: str, source: str, operation: str, rows: int | None = None) -> None:
    """Add one entry; concurrent writers only ever add files."""
    entry = spark.range(1).select(
        F.current_timestamp().alias("at"), F.lit(operation).alias("operation"),
        F.lit(rows).cast("bigint").alias("row_count"), F.lit(source).alias("source"))
    entry.write.mode("append").partitionBy("source").parquet(path)


def recent_lineage(spark: SparkSession, path: str, n: int = ENTRIES_PER_SOURCE) -> DataFrame:
    """The newest entries of every source."""
    return retain_last(spark.read.parquet(path), ["source"], [F.desc("at")], n)
