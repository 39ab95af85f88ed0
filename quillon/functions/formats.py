"""Display formats of measures, chosen from the column's name and type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillon.functions.types import family

# Words in a column name that decide its format.
MONEY_WORDS = ("price", "cost", "revenue", "sales", "amount")
RATE_WORDS = ("percent", "rate")
MEASURE_RATE_WORDS = ("percentage", "percent", "rate")
COUNT_WORDS = ("count", "quantity", "number")
MEASURE_COUNT_WORDS = ("count", "quantity")

# Format patterns by kind.
PATTERNS = {
    "currency": '"$"#,0.00', "percentage": "0.00%", "date": "mm/dd/yyyy",
    "whole_number": "#,0", "decimal": "#,0.00", "general": "General",
}


def _has(name: str, terms) -> bool:
    return any(term in name.lower() for term in terms)


def measure_format(name: str, aggregation: str = "SUM") -> str:
    """Format label of a measure."""
    if _has(name, MONEY_WORDS):
        return "Currency"
    if _has(name, MEASURE_RATE_WORDS):
        return "Percentage"
    if aggregation == "COUNT" or _has(name, MEASURE_COUNT_WORDS):
        return "Whole Number"
    return "General Number"


def format_kind(name: str, type_name: str) -> str:
    """Kind of format for a column."""
    kind = family(type_name)
    if _has(type_name, ("currency", "money")) or _has(name, MONEY_WORDS):
        return "currency"
    if _has(name, RATE_WORDS):
        return "percentage"
    if kind == "datetime":
        return "date"
    if kind == "integer" and _has(name, COUNT_WORDS):
        return "whole_number"
    if kind in ("float", "decimal"):
        return "decimal"
    return "general"


def format_measure(col: Column, name: str, type_name: str) -> Column:
    """The value as display text."""
    kind = format_kind(name, type_name)
    if kind == "currency":
        shown = F.format_number(F.abs(col), 2)
        return F.when(col < 0, F.concat(F.lit("-$"), shown)).when(col.isNotNull(), F.concat(F.lit("$"), shown))
    if kind == "percentage":
        return F.when(col.isNotNull(), F.format_string("%.2f%%", col.cast("double") * 100))
    if kind == "date":
        return F.date_format(col, "MM/dd/yyyy")
    if kind == "whole_number":
        return F.format_number(col, 0)
    if kind == "decimal":
        return F.format_number(col, 2)
    return col.cast("string")
