"""Business measures, their KPI status and time intelligence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.formats import measure_format
from quillon.functions.scalars import divide, measure_title


@dataclass(frozen=True)
class Measure:
    """An aggregate with its display name; ``column`` is a column's name, or an expression as a Column."""

    column: str | Column
    aggregation: str = "SUM"
    name: str | None = None
    category: str = "Basic Measures"

    @property
    def title(self) -> str:
        return self.name or measure_title(str(self.column))

    @property
    def format(self) -> str:
        return measure_format(self.title if not isinstance(self.column, str) else self.column, self.aggregation)

    def expression(self) -> Column:
        col = F.col(f"`{self.column}`") if isinstance(self.column, str) else self.column
        kind = self.aggregation.upper()
        if kind == "SUM":
            return F.sum(col)
        if kind in ("AVERAGE", "AVG"):
            return F.avg(col)
        if kind == "COUNT":
            return F.count(col)
        if kind == "DISTINCTCOUNT":
            # a blank is one more distinct value
            return F.count_distinct(col) + F.max(F.when(col.isNull(), 1).otherwise(0)).cast("bigint")
        if kind in ("MIN", "MAX"):
            return (F.min if kind == "MIN" else F.max)(col)
        return F.sum(col)


def measures(df: DataFrame, specs: Sequence[Measure], by: Sequence[str | Column] = ()) -> DataFrame:
    """All measures in one aggregation, per group of ``by``."""
    cells = [m.expression().alias(m.title) for m in specs]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def measure_rows(values: DataFrame, specs: Sequence[Measure]) -> DataFrame:
    """Measures as rows ``(measure, value, format, category)``."""
    cells = [F.struct(F.lit(m.title).alias("measure"), F.col(f"`{m.title}`").cast("double").alias("value"),
                      F.lit(m.format).alias("format"), F.lit(m.category).alias("category")) for m in specs]
    return values.select(F.inline(F.array(*cells)))


def write_measures(rows: DataFrame, path: str) -> None:
    """Measure rows as a table partitioned by category."""
    rows.write.mode("overwrite").partitionBy("category").parquet(path)


# Labels of the KPI status.
ABOVE, ON, BELOW = "Above Target", "On Target", "Below Target"


def kpi(actuals_df: DataFrame, targets_df: DataFrame, on: Sequence[str] = ("measure",),
        tol: float = 0.05) -> DataFrame:
    """Variance against the target, as a value and a share, and its status.

    Measures without a target are left out; a target of zero is a target whose share is blank.
    """
    joined = actuals_df.join(targets_df.where("target IS NOT NULL"), list(on), "inner")
    variance = F.col("actual") - F.col("target")
    status = (F.when(F.col("variance_pct") >= tol, ABOVE).when(F.col("variance_pct") >= -tol, ON)
              .otherwise(BELOW))
    return (joined.withColumn("variance", variance)
            .withColumn("variance_pct", divide(F.col("variance"), F.col("target")))
            .withColumn("status", status))


def period_number(date: Column, grain: str) -> Column:
    """Number of the period inside its year."""
    if grain == "month":
        return F.month(date)
    if grain == "quarter":
        return F.quarter(date)
    if grain == "day":
        return F.month(date) * 100 + F.dayofmonth(date)
    raise ValueError(f"unknown grain {grain!r}")


def time_intelligence(df: DataFrame, date: str, by: Sequence[str], value: Column | str,
                      grain: str = "month") -> DataFrame:
    """Per group and period: the value, its year to date, and both a year before, with growth.

    Rows are summed to the period first. Every total is then entered twice, in its own
    year and as the prior value of the next, so one aggregation and one window over a few
    rows per group and year give all five measures, gaps in the periods included.
    29 February has no twin at day grain; its prior value stays blank.
    """
    day = F.col(date).cast("date")
    col = F.expr(value) if isinstance(value, str) else value
    totals = df.groupBy(*by, F.year(day).alias("year"), period_number(day, grain).alias("period")).agg(
        F.sum(col).alias("total"))
    nothing = F.lit(None).cast(totals.schema["total"].dataType)
    entries = totals.select(*by, "period", F.inline(F.array(
        F.struct(F.col("year"), F.col("total").alias("value"), nothing.alias("prior_year")),
        F.struct((F.col("year") + 1).alias("year"), nothing.alias("value"), F.col("total").alias("prior_year")))))
    # each group and year has one entry per period from either side
    both = entries.groupBy(*by, "year", "period").agg(
        F.max("value").alias("value"), F.max("prior_year").alias("prior_year"))
    to_date = Window.partitionBy(*by, "year").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumns({"ytd": F.sum("value").over(to_date), "pytd": F.sum("prior_year").over(to_date)})
            .where("value IS NOT NULL")
            .withColumn("yoy", divide((F.col("value") - F.col("prior_year")).cast("double"),
                                      F.col("prior_year").cast("double"))))
