"""Rows far from the rest of their column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions.types import numeric_columns
from quillon.operators.percentiles import iqr_bounds, long_numbers


def outliers(df: DataFrame, columns: list[str] | None = None, method: str = "zscore",
             threshold: float = 3.0, factor: float = 1.5, id_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per outlying cell: the id columns, ``column``, ``value`` and its score or fences."""
    columns = columns or [c for c in numeric_columns(df) if c not in id_cols]
    cells = long_numbers(df, columns, tuple(id_cols))
    if method == "zscore":
        stats = long_numbers(df, columns).groupBy("column").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
        # one row per column; a column that never varies has no outliers
        scored = cells.join(F.broadcast(stats.where("deviation > 0")), "column").withColumn(
            "score", F.abs(F.col("value") - F.col("mean")) / F.col("deviation"))
        return scored.where(F.col("score") > threshold).select(*id_cols, "column", "value", "score")
    if method == "iqr":
        fences = iqr_bounds(df, columns, factor)
        outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
        return cells.join(F.broadcast(fences), "column").where(outside).select(
            *id_cols, "column", "value", "lower_bound", "upper_bound")
    raise ValueError(f"unknown outlier method {method!r}")


def outlier_counts(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                   threshold: float = 3.0, factor: float = 1.5) -> DataFrame:
    """Outliers per column, columns without any left out."""
    return outliers(df, columns, method, threshold, factor).groupBy("column").agg(
        F.count("*").alias("outlier_count"))
