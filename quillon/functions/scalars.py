"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column) -> Column:
    """Percentage at two digits, halves to even; NULL when there is nothing to divide by."""
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), 2)


def divide(top: Column, bottom: Column) -> Column:
    """Report-style division: blank (NULL) where the divisor is zero or missing."""
    return F.try_divide(top, bottom)


def money(col: Column) -> Column:
    """Money as a fixed-point number, so that sums do not depend on row order."""
    return col.cast("decimal(18,4)")


# The four kinds of secret and the mark that replaces their value.
SECRET_NAMES = ("api[_-]?key", "password", "token", "secret")
REDACTED = "***REDACTED***"
# White space of any script, as a character class body.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def redact(col: Column) -> Column:
    """Mask the value after a secret's name, whatever the case; the name stays."""
    masked = col
    for name in SECRET_NAMES:
        around = f'["{SPACE}]*'
        masked = F.regexp_replace(masked, f'(?iu)({name}{around}[:=]{around})[^{SPACE}"]+', f"$1{REDACTED}")
    # most texts name no secret: a plain search spares them the replacements. Either case is
    # looked for, since some letters fold to these only one way.
    def holds(word: str) -> Column:
        return F.lower(col).contains(word) | F.upper(col).contains(word.upper())

    named = (holds("api") & holds("key")) | holds("password") | holds("token") | holds("secret")
    return F.when(named, masked).otherwise(col)


def words(col: Column) -> Column:
    """Lower-case words (letters, digits, underscore of any script) in order, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def measure_title(name: str) -> str:
    """Display name of a summed column."""
    return "Total " + name.replace("_", " ").title()
