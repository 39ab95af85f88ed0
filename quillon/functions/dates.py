"""Calendar columns and the date dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def date_parts(day: Column) -> dict[str, Column]:
    """The calendar attributes of a date, Monday being day 1 and weeks as in ISO 8601."""
    quarter = F.concat(F.lit("Q"), F.quarter(day))
    return {
        "year": F.year(day),
        "quarter": quarter,
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "month_short": F.date_format(day, "MMM"),
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day) + 1,
        "day_name": F.date_format(day, "EEEE"),
        "day_short": F.date_format(day, "EEE"),
        "week_of_year": F.weekofyear(day),
        "is_weekend": F.weekday(day) >= 5,
        "year_month": F.date_format(day, "yyyy-MM"),
        "year_quarter": F.concat_ws("-", F.year(day).cast("string"), quarter),
    }


def _with_parts(days: DataFrame) -> DataFrame:
    return days.select("date", *[c.alias(n) for n, c in date_parts(F.col("date")).items()])


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return _with_parts(spark.range(1).select(F.explode(days).alias("date")))


def date_dimension_for(df: DataFrame, column: str) -> DataFrame:
    """A calendar that covers the dates found in ``column``."""
    day = F.col(column).cast("date")
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo IS NOT NULL")
    return _with_parts(span.select(F.explode(F.sequence("lo", "hi")).alias("date")))
