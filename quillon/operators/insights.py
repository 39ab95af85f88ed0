"""Automatic findings about a dataset: gaps, correlation, outliers, cardinality, imbalance, trend."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.functions.scalars import percent
from quillon.functions.types import numeric_columns, text_columns, value_or_null
from quillon.operators.outliers import outlier_counts, outliers
from quillon.operators.profile import frequencies, top_values

def missing(df: DataFrame, warn_above: float = 20.0) -> DataFrame:
    """Missing cells of the whole dataset, one row; none when nothing is missing."""
    holes = sum((F.count_if(value_or_null(df, c).isNull()) for c in df.columns), F.lit(0))
    pct = F.col("missing_count") * 100.0 / (F.col("row_count") * len(df.columns))
    return (df.agg(F.count("*").alias("row_count"), holes.cast("bigint").alias("missing_count"))
            .where("missing_count > 0")
            .select("row_count", "missing_count", pct.cast("double").alias("missing_percentage"))
            .withColumn("severity", F.when(F.col("missing_percentage") > warn_above, "warning").otherwise("info")))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson's r of every pair of columns over the rows that have both; NULL if one is constant.

    A task multiplies its rows as matrices, batch by batch, and leaves sums for each pair of columns; only these are shuffled.
    Values are taken from their column's mean, so that large numbers with small differences lose nothing.
    """
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation needs two numeric columns")
    value = [value_or_null(df, c).cast("double") for c in columns]
    means = df.agg(F.array(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in value])).scalar()
    held = df.select(*[(v - means[i]).alias(f"c{i}") for i, v in enumerate(value)])
    k = len(columns)
    first, second = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            have = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
            with np.errstate(invalid="ignore", over="ignore"):
                square = x * x
                sums += (have.T @ have, x.T @ have, have.T @ x, square.T @ have, have.T @ square, x.T @ x)
        parts = [pa.array(np.arange(len(first), dtype=np.int32)), *[pa.array(s[first, second]) for s in sums]]
        yield pa.RecordBatch.from_arrays(parts, names=["pair", "n", "x", "y", "xx", "yy", "xy"])

    made = held.mapInArrow(run, "pair int, n double, x double, y double, xx double, yy double, xy double")
    found = made.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    shared = F.col("xy") / n - (F.col("x") / n) * (F.col("y") / n)
    spread = [F.greatest(F.col(q) / n - F.pow(F.col(s) / n, 2), F.lit(0.0)) for q, s in (("xx", "x"), ("yy", "y"))]
    # a spread of rounding errors is none
    steady = [v <= 1e-14 * (F.col(q) / n) for v, q in zip(spread, ("xx", "yy"))]
    r = F.when(~steady[0] & ~steady[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shared / F.sqrt(spread[0] * spread[1]))))
    names = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b")) for a, b in combinations(columns, 2)])
    return found.withColumn("r", r).withColumn("names", F.get(names, F.col("pair"))).select("names.column_a", "names.column_b", "r")


def high_correlation(df: DataFrame, columns: list[str] | None = None, limit: float = 0.7) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > limit)


def outlier_share(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Outliers outside the quartile fences per column, as a share of all rows."""
    total = df.agg(F.count("*").alias("row_count")).scalar()
    counts = outlier_counts(df, columns, "iqr", factor=factor)
    return counts.select("column", "outlier_count", percent(F.col("outlier_count"), total).alias("outlier_percentage"))


def value_counts_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, distinct values and the rows of the most frequent one, per text column.

    Columns without values give no row.
    """
    best = F.max(F.when(F.col("key").isNotNull(), F.col("rows")))
    freq = frequencies(df, columns or text_columns(df))
    return (freq.groupBy("column").agg(
        F.sum("rows").alias("row_count"), F.count("key").alias("unique_count"), best.alias("top_rows"))
        .where("unique_count > 0"))


def high_cardinality(df: DataFrame, columns: list[str] | None = None, above: int = 10) -> DataFrame:
    return value_counts_summary(df, columns).where(F.col("unique_count") > above).select("column", "unique_count")


def imbalance(df: DataFrame, columns: list[str] | None = None, max_values: int = 10,
              share: float = 80.0) -> DataFrame:
    """Text columns of few values where one value holds most of all rows, with that value."""
    columns = columns or text_columns(df)
    pct = F.col("top_rows") * 100.0 / F.col("row_count")
    return (value_counts_summary(df, columns)
            .where((F.col("unique_count") <= max_values) & (pct > share))
            .join(top_values(df, columns, 1).select("column", "value"), "column")
            .select("column", "value", "top_rows",
                    pct.cast("double").alias("top_percentage")))


def trend(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """Slope and fit of the value's total per period against the period number, one row."""
    start = F.date_trunc(grain, F.col(date).cast("timestamp"))
    per = df.groupBy(start.alias("period")).agg(F.sum(value).cast("double").alias("total"))
    # the period number counts months or days from a fixed point, so no global window is needed
    number = {
        "month": F.year("period") * 12 + F.month("period"),
        "quarter": F.year("period") * 4 + F.quarter("period"),
        "year": F.year("period"),
        "week": F.floor(F.unix_date(F.col("period").cast("date")) / 7),
        "day": F.unix_date(F.col("period").cast("date")),
    }[grain].cast("double")
    return per.where("period IS NOT NULL").withColumn("number", number).agg(
        F.count("*").alias("periods"), F.regr_slope("total", "number").alias("slope"),
        F.regr_r2("total", "number").alias("r2"), F.avg("total").alias("mean_total"))


def period_anomalies(df: DataFrame, date: str, value: str, grain: str = "month",
                     threshold: float = 3.0) -> DataFrame:
    """Periods whose total is far from the mean of all periods."""
    start = F.date_trunc(grain, F.col(date).cast("timestamp"))
    per = df.groupBy(start.alias("period")).agg(F.sum(value).cast("double").alias("total"))
    return outliers(per, ["total"], "zscore", threshold, id_cols=("period",))


INSIGHT_COLUMNS = ("type", "severity", "column", "value", "detail")


def insights(df: DataFrame, corr: float = 0.7, iqr: float = 1.5, max_card: int = 10,
             imbalance_share: float = 80.0) -> DataFrame:
    """All findings in one shape: ``type, severity, column, value, detail``."""
    def rows(frame: DataFrame, kind: str, severity, column, value, detail) -> DataFrame:
        return frame.select(F.lit(kind).alias("type"), severity.alias("severity"), column.alias("column"),
                            value.cast("double").alias("value"), detail.cast("string").alias("detail"))

    none, info = F.lit(None).cast("string"), F.lit("info")
    numbers, texts = numeric_columns(df), text_columns(df)
    shape = df.agg(F.count("*").alias("n")).where("n > 0")
    found = [
        rows(shape, "data_shape", info, none, F.col("n"), F.lit(f"{len(df.columns)} columns")),
        rows(missing(df), "missing_values", F.col("severity"), none, F.col("missing_percentage"), none),
    ]
    if len(numbers) > 1:
        found.append(rows(high_correlation(df, numbers, corr), "high_correlation", info, F.col("column_a"),
                          F.col("r"), F.col("column_b")))
    if numbers:
        found.append(rows(outlier_share(df, numbers, iqr), "outliers", info, F.col("column"),
                          F.col("outlier_percentage"), F.col("outlier_count")))
    if texts:
        found.append(rows(high_cardinality(df, texts, max_card), "high_cardinality", info, F.col("column"),
                          F.col("unique_count"), none))
        found.append(rows(imbalance(df, texts, max_card, imbalance_share), "imbalanced", info, F.col("column"),
                          F.col("top_percentage"), F.col("value")))
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out
