"""Quality issues, declarative rules, the overall score and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.types import map_type, numeric_columns, value_or_null

# Name endings of columns that should not be negative.
NON_NEGATIVE_ENDINGS = ("_id", "id", "count", "quantity", "amount")

# Points lost per finding (above 50 %, above 20 %), default and strict.
NULL_POINTS = {False: (15, 5), True: (30, 10)}
DUPLICATE_POINTS = {False: (10, 3), True: (20, 5)}
ISSUE_POINTS = {"error": 20, "other": 5}


def quality_issues(columns_df: DataFrame, max_null: float = 30.0, max_dup: float = 10.0) -> DataFrame:
    """Threshold findings ``(column, type, severity, percentage, threshold)`` from column counts."""
    def issue(kind: str, severity: Column, pct: str, limit: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), severity.alias("severity"),
                        F.col(pct).alias("percentage"), F.lit(float(limit)).alias("threshold"))

    nulls = issue("high_null_percentage", F.when(F.col("null_percentage") > 50, "error").otherwise("warning"),
                  "null_percentage", max_null)
    dups = issue("high_duplicate_percentage", F.lit("warning"), "duplicate_percentage", max_dup)
    return columns_df.select("column", F.inline(F.filter(
        F.array(nulls, dups), lambda i: i["percentage"] > i["threshold"])))


def empty_issue(columns_df: DataFrame) -> DataFrame:
    """The single error of a dataset without rows; no row otherwise."""
    return columns_df.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows")).where("rows = 0").select(
        F.lit(None).cast("string").alias("column"), F.lit("empty_dataset").alias("type"),
        F.lit("error").alias("severity"), F.lit(None).cast("double").alias("percentage"),
        F.lit(None).cast("double").alias("threshold"))


def _lost(pct: str, points: tuple[int, int]) -> Column:
    return F.when(F.col(pct) > 50, points[0]).when(F.col(pct) > 20, points[1]).otherwise(0)


def quality_score(columns_df: DataFrame, issues_df: DataFrame, strict: bool = False) -> DataFrame:
    """One row with the score from 0 to 100; a dataset without rows scores 0."""
    points = F.sum(_lost("null_percentage", NULL_POINTS[strict])
                   + _lost("duplicate_percentage", DUPLICATE_POINTS[strict]))
    columns = columns_df.agg(F.struct(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("rows"), F.coalesce(points, F.lit(0)).alias("points")))
    found = issues_df.agg(
        F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"),
    ).withColumn("columns", columns.scalar())
    raw = (100 - F.col("error_count") * ISSUE_POINTS["error"]
           - (F.col("issue_count") - F.col("error_count")) * ISSUE_POINTS["other"] - F.col("columns.points"))
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return found.select(
        F.col("columns.rows").alias("row_count"), "issue_count", "error_count",
        F.when(F.col("columns.rows") == 0, 0.0).otherwise(bounded.cast("double")).alias("score"))


def passes_gate(score_df: DataFrame, minimum: float = 75.0) -> DataFrame:
    """The score row if it is above the gate, else nothing."""
    return score_df.where(F.col("score") > minimum)


def recommendations(score_df: DataFrame, issues_df: DataFrame, minimum: float = 80.0) -> DataFrame:
    """Advice rows ``(column, advice)``."""
    overall = score_df.where(F.col("score") < minimum).select(
        F.lit(None).cast("string").alias("column"),
        F.lit("clean the data: the overall score is low").alias("advice"))
    advice = (F.when(F.col("type") == "high_null_percentage", "fill or explain the missing values")
              .when(F.col("type") == "high_duplicate_percentage", "check whether repeated values are expected")
              .when(F.col("type") == "empty_dataset", "check the connection and the query"))
    return overall.unionByName(
        issues_df.select("column", advice.alias("advice")).where("advice IS NOT NULL"))


def _bad(df: DataFrame, rule: dict, column: str) -> Column:
    col = value_or_null(df, column)
    if rule["type"] == "column_pattern":
        return ~col.cast("string").rlike(f"^(?:{rule['pattern']})")
    if rule["type"] == "type_consistency":
        return col.cast("string").try_cast(map_type(rule["data_type"])).isNull()
    if rule["type"] == "non_negative":
        return col < 0
    raise ValueError(f"unknown rule type {rule['type']!r}")


def negative_rule(df: DataFrame, severity: str = "warning") -> dict:
    """Rule over the numeric columns whose names say they count or identify something."""
    names = [c for c in numeric_columns(df) if c.lower().endswith(NON_NEGATIVE_ENDINGS)]
    return {"type": "non_negative", "columns": names, "severity": severity}


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per rule and column with the values checked and broken, from one aggregation.

    Rules are ``{"type", "columns", "severity"}`` plus ``pattern`` or ``data_type``. Every
    row is tested; missing values break no rule. Columns the frame lacks are passed over.
    """
    cells = []
    for rule in rules:
        for column in rule["columns"]:
            if column not in df.columns:
                continue
            col = value_or_null(df, column)
            cells.append(F.struct(
                F.lit(rule["type"]).alias("rule"), F.lit(column).alias("column"),
                F.lit(rule.get("severity", "warning")).alias("severity"),
                F.count(col).alias("checked"),
                F.count_if(col.isNotNull() & _bad(df, rule, column)).alias("violations")))
    if not cells:
        raise ValueError("no rule applies to a column of this frame")
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def rule_issues(results: DataFrame) -> DataFrame:
    """Broken rules in the shape of :func:`quality_issues`."""
    return results.where("violations > 0").select(
        "column", F.concat_ws("_", F.lit("rule"), "rule").alias("type"), "severity",
        F.bround(F.try_divide(F.col("violations") * 100.0, F.col("checked")), 2).cast("double").alias("percentage"),
        F.lit(0.0).alias("threshold"))


def union_issues(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
