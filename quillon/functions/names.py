"""What a column's name and type say about its role, as expressions over a catalog."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillon.functions.types import FAMILY_OF

# Words that mark keys, measures, places and categories.
KEY_WORDS = ("id", "key", "pk")
KEY_ENDINGS = ("key", "pk")
MEASURE_WORDS = ("amount", "total", "sum", "count", "quantity", "price", "value")
FACT_MEASURE_WORDS = MEASURE_WORDS + ("revenue", "sales", "cost")
PLACE_WORDS = ("country", "region", "city", "state", "location")
CATEGORY_WORDS = ("category", "type", "class", "group")
MEAN_WORDS = ("average", "avg", "mean", "rate", "percentage", "percent")
SUM_WORDS = ("count", "quantity", "number", "amount", "total", "value", "price")
# Words that hold a measure word by accident.
ACCIDENTS = ("discount", "account", "country", "county", "consume", "summary", "assume")

NUMERIC_FAMILIES = ("integer", "float", "decimal")


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def contains_word(name: Column, terms, legacy: bool = True) -> Column:
    """Substring test; without ``legacy`` the accidental words do not count."""
    text = F.lower(name)
    if not legacy:
        text = F.regexp_replace(text, "|".join(ACCIDENTS), "")
    return any_of([text.contains(t) for t in terms])


def family_of(type_name: Column) -> Column:
    """Family of a type name; arrays and other nested types belong to none."""
    base = F.regexp_extract(F.lower(type_name), r"^[a-z0-9_]+", 0)
    names = dict(FAMILY_OF, long="integer", short="integer", byte="integer",
                 timestamp_ntz="datetime", timestamp_ltz="datetime",
                 array="nested", map="nested", struct="nested")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, base), F.lit("string"))


def is_key_name(name: Column, legacy: bool = False) -> Column:
    if legacy:
        return contains_word(name, KEY_WORDS)
    parts = F.split(F.lower(name), "_")
    whole = any_of([F.array_contains(parts, w) for w in KEY_WORDS])
    return whole | F.lower(name).rlike("(" + "|".join(KEY_ENDINGS) + ")(_|$)")


def is_foreign_key_name(name: Column, suffixes=("_id", "key"), legacy: bool = False) -> Column:
    return any_of([F.lower(name).endswith(s) for s in (("_id", "id") if legacy else suffixes)])


def is_numeric(type_name: Column) -> Column:
    return family_of(type_name).isin(*NUMERIC_FAMILIES)


def is_measure(name: Column, type_name: Column, terms=MEASURE_WORDS, legacy: bool = False) -> Column:
    return is_numeric(type_name) & contains_word(name, terms, legacy)


def is_dimension(type_name: Column) -> Column:
    return family_of(type_name).isin("string", "datetime")


def suggested_aggregation(name: Column) -> Column:
    """Sums first, then means; sums also where the name says nothing."""
    return (F.when(contains_word(name, SUM_WORDS), "SUM")
            .when(contains_word(name, MEAN_WORDS), "AVERAGE").otherwise("SUM"))


def dimension_category(name: Column, type_name: Column) -> Column:
    return (F.when(family_of(type_name) == "datetime", "time")
            .when(contains_word(name, PLACE_WORDS), "geography")
            .when(contains_word(name, CATEGORY_WORDS), "category").otherwise("attribute"))
