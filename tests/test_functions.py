import datetime

import pytest
from pyspark.sql import functions as F, types as T

from quillon.functions import crypto, dates, formats, nested, scalars, types
from tests.conftest import rows


@pytest.mark.parametrize("name, family, spark_type", [
    ("INT", "integer", T.LongType()), ("tinyint", "integer", T.LongType()), ("real", "float", T.DoubleType()),
    ("double", "float", T.DoubleType()), ("numeric", "decimal", T.DecimalType(38, 18)),
    ("DECIMAL(10, 2)", "decimal", T.DecimalType(10, 2)), ("money", "decimal", T.DecimalType(19, 4)),
    ("nvarchar(20)", "string", T.StringType()), ("date", "datetime", T.DateType()),
    ("datetime2", "datetime", T.TimestampType()), ("time", "datetime", T.StringType()),
    ("bit", "boolean", T.BooleanType()), ("image", "binary", T.BinaryType()), ("geography", "string", T.StringType()),
    ("float64", "float", T.DoubleType()), ("datetime64[ns]", "datetime", T.TimestampType()),
])
def test_type_names(name, family, spark_type):
    assert types.family(name) == family
    assert types.map_type(name) == spark_type


def test_model_types():
    assert [types.model_type(n) for n in ("bigint", "timestamp", "bool", "money")] == \
        ["int64", "dateTime", "boolean", "decimal"]


def test_cast_plan_and_lost_values(spark):
    df = spark.createDataFrame([("1", "x"), ("two", "y"), (None, "z")], "a string, b string")
    assert rows(types.cast_plan(df, {"a": "int"})) == [(None, "y"), (None, "z"), (1, "x")]
    assert rows(types.failed_casts(df, {"a": "int"})) == [("a", "bigint", 2, 1)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert rows(df.select(types.value_or_null(df, "v").alias("v"))) == [(None,), (None,), (1.0,)]


def test_percent_rounds_half_to_even(spark):
    df = spark.range(1).select(scalars.percent(F.lit(1), F.lit(800)).alias("a"), scalars.percent(F.lit(1), F.lit(0)).alias("b"))
    assert rows(df) == [(0.12, None)]


def test_redact(spark):
    cases = [
        ('api_key=abc123 rest', 'api_key=***REDACTED*** rest'),
        ('{"password": "hunter2", "x": 1}', '{"password": "***REDACTED***", "x": 1}'),
        ('Token: ABC', 'Token: ***REDACTED***'), ('my SECRET = s3 apikey:k', 'my SECRET = ***REDACTED*** apikey:***REDACTED***'),
        ('ſecret=a', 'ſecret=***REDACTED***'), ('token=a b', 'token=***REDACTED*** b'),
        ('tokens are fine', 'tokens are fine'), ('nothing here', 'nothing here'),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(scalars.redact(F.col("t"))).collect()] == [b for _, b in cases]


def test_words_keep_repeats_and_scripts(spark):
    df = spark.createDataFrame([("Über-Größe a_b 12 a_b",)], "t string")
    assert df.select(scalars.words(F.col("t"))).first()[0] == ["über", "größe", "a_b", "12", "a_b"]


def test_measure_title():
    assert scalars.measure_title("net_price") == "Total Net Price"


def test_encryption_round_trip(spark):
    key = crypto.derive_key("pass phrase", b"0123456789abcdef")
    assert len(key) == 32 and key == crypto.derive_key("pass phrase", b"0123456789abcdef")
    df = spark.createDataFrame([(1, "geheim"), (2, "geheim"), (3, None)], "i int, s string")
    locked = crypto.encrypt_columns(df, ["s"], key).persist()
    values = [r.s for r in locked.orderBy("i").collect()]
    assert values[0] != values[1] and values[2] is None  # a new IV each
    assert rows(crypto.decrypt_columns(locked, ["s"], key)) == rows(df)
    with pytest.raises(ValueError):
        crypto.derive_key("x", b"short")


def test_date_dimension(spark):
    got = {r.date: r for r in dates.date_dimension(spark, "2021-01-02", "2021-01-04").collect()}
    assert len(got) == 3
    sunday = got[datetime.date(2021, 1, 3)]
    assert (sunday.quarter, sunday.month_name, sunday.month_short, sunday.day_of_week, sunday.day_name,
            sunday.week_of_year, sunday.is_weekend, sunday.year_month, sunday.year_quarter) == \
        ("Q1", "January", "Jan", 7, "Sunday", 53, True, "2021-01", "2021-Q1")
    assert got[datetime.date(2021, 1, 4)].day_of_week == 1


@pytest.mark.parametrize("name, kind, expected", [
    ("unit_price", "double", "currency"), ("tax_rate", "double", "percentage"), ("ship_date", "date", "date"),
    ("item_count", "int", "whole_number"), ("weight", "float", "decimal"), ("label", "varchar", "general"),
    ("anything", "money", "currency"), ("age", "int", "general"),
])
def test_format_kind(name, kind, expected):
    assert formats.format_kind(name, kind) == expected


def test_measure_format():
    assert [formats.measure_format(n, a) for n, a in (
        ("sales", "SUM"), ("tax_rate", "AVERAGE"), ("id", "COUNT"), ("quantity", "SUM"), ("weight", "SUM"))] == \
        ["Currency", "Percentage", "Whole Number", "Whole Number", "General Number"]


def test_formatted_values(spark):
    df = spark.range(1).select(
        formats.format_measure(F.lit(-1234.5), "price", "double").alias("a"),
        formats.format_measure(F.lit(0.125), "rate", "double").alias("b"),
        formats.format_measure(F.lit(12345), "order_count", "int").alias("c"),
        formats.format_measure(F.lit(None).cast("double"), "price", "double").alias("d"))
    assert rows(df) == [("-$1,234.50", "12.50%", "12,345", None)]


def test_flatten_nested(spark):
    schema = "a STRUCT<b: INT, c: STRUCT<d: STRING>>, tags ARRAY<STRUCT<x: INT>>"
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": "z"}}, "tags": [{"x": 5}, {"x": 6}]}'),
                                (2, '{"a": {"b": 2}}'), (3, "broken")], "i int, j string")
    parsed = nested.parse_json(df, "j", schema).select("i", "doc")
    flat = nested.flatten_structs(parsed)
    assert flat.columns == ["i", "doc.a.b", "doc.a.c.d", "doc.tags[]"]
    exploded = nested.explode_array(flat, "doc.tags[]")
    assert rows(exploded) == [(1, 1, "z", 5), (1, 1, "z", 6), (2, 2, None, None), (3, None, None, None)]
