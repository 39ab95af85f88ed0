"""Column profiles as sketches: small, made in one pass, stored, and merged with those of other batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions.types import numeric_columns, value_or_null
from quillon.operators.profile import _as_text

#: Binary logarithm of the registers of a distinct-count sketch; its relative standard error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12
#: Size of a quantile sketch: ranks are right within ``RANK_ERROR`` in 99 of 100 cases.
QUANTILE_SIZE = 400
RANK_ERROR = 0.0067
#: Items that a frequent-item sketch holds. A value's count is wrong by less than rows / HEAVY_ITEMS * 4.
HEAVY_ITEMS = 1024
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def distinct_error() -> float:
    """Three relative standard errors of a distinct count."""
    return 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def sketch_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: ``column, row_count, null_count, distinct_sketch, quantile_sketch, heavy_sketch, min_number, max_number``.

    Every task folds its rows into sketches and only these are shuffled. The quantile sketch is null for columns that are no
    numbers. A missing value (null or NaN) is in no sketch. An empty table gives no rows.
    """
    columns = columns or df.columns
    numbers = set(numeric_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("text"),
                      (value_or_null(df, c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number")) for c in columns]
    each = df.select(F.inline(F.array(*cells)))
    return each.groupBy("column").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("text").isNull()).alias("null_count"),
        F.hll_sketch_agg("text", LOG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double("number", QUANTILE_SIZE).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(text, {HEAVY_ITEMS}) FILTER (WHERE text IS NOT NULL)").alias("heavy_sketch"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The rows of :func:`sketch_columns` of several batches as those of all their rows."""
    return sketches.groupBy("column").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(heavy_sketch, {HEAVY_ITEMS})").alias("heavy_sketch"),
        F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"))


def sketch_report(sketches: DataFrame, top: int = 10) -> DataFrame:
    """``column, row_count, null_count, unique_count, p25, median, p75, min_number, max_number, top_values`` as the sketches
    estimate them; ``top_values`` is an array of value and rows. Quantiles are null without numbers."""
    known = F.col("max_number").isNotNull()
    quantiles = [F.when(known, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(c) for c, q in QUARTILES.items()]
    return sketches.select(
        "column", "row_count", "null_count", F.hll_sketch_estimate("distinct_sketch").alias("unique_count"), *quantiles,
        "min_number", "max_number", F.expr(f"transform(approx_top_k_estimate(heavy_sketch, {top}), "
                                           "t -> struct(t.item AS value, t.count AS rows))").alias("top_values"))
