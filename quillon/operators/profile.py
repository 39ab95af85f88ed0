"""Column and dataset profiles, each statistic family from one distributed pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillon.functions.scalars import percent
from quillon.functions.types import (
    datetime_columns, numeric_columns, spark_family, text_columns, value_or_null,
)
from quillon.operators.percentiles import quantile_table

LONG_VALUE_BYTES = 64
HEAD_CHARS = 64


def _as_text(df: DataFrame, name: str) -> Column:
    col = value_or_null(df, name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BinaryType):
        return F.base64(col)
    if isinstance(dtype, (T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def _key(text: Column) -> Column:
    """The value itself, or its SHA-256 when long, so that whole texts are not shuffled."""
    return F.when(F.octet_length(text) > LONG_VALUE_BYTES, F.sha2(text, 256)).otherwise(text)


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.select(*[_as_text(df, c).alias(c) for c in columns])
    return wide.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "text")


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    return _cells(df, columns).select("column", _key(F.col("text")).alias("key"), F.char_length("text").alias("length"),
                                      F.substring("text", 1, HEAD_CHARS).alias("head"))


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows ``(column, key, rows, length, head)`` per distinct value; a missing value has a NULL key.

    ``key`` stands for a long value; ``head`` holds its first characters.
    """
    return _keyed(df, columns or df.columns).groupBy("column", "key").agg(
        F.count("*").alias("rows"), F.max("length").alias("length"), F.max("head").alias("head"))


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _label(df: DataFrame) -> Column:
    pairs = [F.lit(x) for pair in column_types(df).items() for x in pair]
    return F.create_map(*pairs)[F.col("column")]


def column_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, missing, distinct and duplicate counts per column.

    A missing value is no distinct value, so every one of them counts as a duplicate.
    ``approx`` estimates the distinct counts in one aggregation without a wide shuffle.
    """
    if approx:
        cells = [F.struct(
            F.lit(c).alias("column"), F.count("*").alias("row_count"),
            F.count_if(value_or_null(df, c).isNull()).alias("null_count"),
            F.approx_count_distinct(value_or_null(df, c), 0.01).alias("unique_count")) for c in df.columns]
        counts = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    else:
        counts = frequencies(df).groupBy("column").agg(
            F.sum("rows").alias("row_count"),
            F.sum(F.when(F.col("key").isNull(), F.col("rows")).otherwise(0)).alias("null_count"),
            F.count("key").alias("unique_count"))
    duplicates = F.col("row_count") - F.col("unique_count")
    return counts.select(
        "column", _label(df).alias("data_type"), "row_count", "null_count",
        percent(F.col("null_count"), F.col("row_count")).alias("null_percentage"),
        "unique_count", duplicates.alias("duplicate_count"),
        percent(duplicates, F.col("row_count")).alias("duplicate_percentage"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None, median: bool = True) -> DataFrame:
    """Extremes, mean, sample deviation, population skewness and excess kurtosis, median."""
    columns = columns or numeric_columns(df)
    cells = []
    for c in columns:
        v = value_or_null(df, c).cast("double")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis")))
    stats = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    if not median:
        return stats
    return stats.join(quantile_table(df, columns, {"median": 0.5}), "column", "left")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of every numeric column."""
    columns = columns or numeric_columns(df)
    quart = quantile_table(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    stats = numeric_stats(df, columns, median=False).select("column", "count", "mean", "std", "min", "max")
    return stats.join(quart, "column", "left")


def top_values(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """The most frequent values per column; equal counts in ascending order of the value.

    Values are ranked by their counts and first characters, which are all that is shuffled of a long
    one. The whole texts of those that can be among the first, ties of equal beginnings
    included, then settle the order.
    """
    columns = columns or text_columns(df)
    rough = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("head"))
    near = (frequencies(df, columns).where("key IS NOT NULL")
            .withColumn("place", F.rank().over(rough)).where(F.col("place") <= top)
            .select("column", "key", "rows", "length", "head"))
    longest = (_cells(df, columns).where(F.octet_length("text") > LONG_VALUE_BYTES)
               .select("column", F.sha2("text", 256).alias("key"), "text"))
    texts = longest.join(near.select("column", "key"), ["column", "key"], "left_semi").groupBy("column", "key").agg(
        F.max("text").alias("text"))
    value = F.coalesce("text", "key")
    order = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("value"))
    return (near.join(texts, ["column", "key"], "left").select("column", value.alias("value"), "rows")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("column", "rank", "value", "rows"))


def text_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Length statistics and whether the values occur about equally often."""
    columns = columns or text_columns(df)
    spread = F.stddev_samp("rows")
    return frequencies(df, columns).where("key IS NOT NULL").groupBy("column").agg(
        F.count("*").alias("unique_count"),
        F.when(spread < 1, "uniform").otherwise("skewed").alias("value_distribution"),
        (F.sum(F.col("length") * F.col("rows")) / F.sum("rows")).alias("avg_length"),
        F.max("length").alias("max_length"), F.min("length").alias("min_length"))


def datetime_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First and last moment, and the whole days of 24 hours between them."""
    cells = []
    for c in columns or datetime_columns(df):
        at = F.col(f"`{c}`").cast("timestamp")
        cells.append(F.struct(F.lit(c).alias("column"), F.min(at).alias("min_date"), F.max(at).alias("max_date")))
    days = F.floor((F.unix_micros("max_date") - F.unix_micros("min_date")) / F.lit(86_400_000_000))
    return (df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
            .withColumn("date_range_days", days.cast("bigint")))


# Bytes per stored value of fixed-width types.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
          "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def memory_estimate(df: DataFrame) -> Column:
    """Estimated bytes: real lengths for text and binary, fixed widths for the rest."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if spark_family(field.dataType) in ("string", "binary") and kind in ("string", "binary"):
            size = F.sum(F.octet_length(col))
        elif isinstance(field.dataType, T.DecimalType):
            size = F.count("*") * (8 if field.dataType.precision <= 18 else 16)
        elif kind in WIDTHS:
            size = F.count("*") * WIDTHS[kind]
        else:
            size = F.sum(F.octet_length(F.to_json(F.struct(col))))
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("bigint")


def dataset_row(df: DataFrame) -> DataFrame:
    """Shape and estimated size of the dataset."""
    return df.agg(F.count("*").alias("row_count"), memory_estimate(df).alias("memory_bytes")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "memory_bytes")


def profile(df: DataFrame, approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(dataset, columns)``: the shape row and one row per column with its statistics."""
    parts = [column_counts(df, approx)]
    if numeric_columns(df):
        parts.append(numeric_stats(df, median=not approx))
    if text_columns(df):
        parts.append(text_stats(df).drop("unique_count"))
    if datetime_columns(df):
        parts.append(datetime_stats(df))
    columns = parts[0]
    for part in parts[1:]:
        columns = columns.join(part, "column", "left")
    return dataset_row(df), columns
