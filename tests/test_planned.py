"""Parts of a database table with a hot key, from counts of the database."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import planned

DERBY = {"type": "jdbc", "url": "jdbc:derby:memory:planned;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    records = [(i, 77) for i in range(4000)]  # one key has four rows of ten
    records += [(i, rng.randrange(-50, 50)) for i in range(3000)] + [(i, 10 ** 9 + i) for i in range(2900)] + [(i, None) for i in range(100)]
    spark.createDataFrame(records, "ID int, K int").write.format("jdbc").options(
        url=DERBY["url"], driver=DERBY["driver"], dbtable="FACTS").save()
    return records


def sizes(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_parts_are_even_although_a_key_is_hot(spark, table):
    df = planned.read_planned(spark, DERBY, "FACTS", "K", 10, spread="ID")
    assert sorted(((r.ID, r.K) for r in df.collect()), key=str) == sorted(table, key=str)
    assert max(sizes(df)) <= 1000 and len(sizes(df)) <= 25


def test_without_a_second_column_only_the_hot_value_is_large(spark, table):
    df = planned.read_planned(spark, DERBY, "FACTS", "K", 10)
    found = sorted(sizes(df))
    assert sum(found) == 10_000 and found[-1] >= 4000 and found[-2] <= 1000


def test_parts_meet_without_gaps(spark, table):
    predicates = planned.planned_predicates(spark, DERBY, "FACTS", "K", 10, spread="ID")
    # rows that come after the plan, of values it has not seen, are in exactly one part
    late = spark.createDataFrame([(i, k) for i in (-9, 5, 10 ** 8) for k in (-10 ** 6, 76, 77, 78, 500, 10 ** 9 + 3, 2 * 10 ** 9, None)] + [(None, 77)], "ID int, K int")
    hits = late.select(sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates), F.lit(0)).alias("n"))
    assert {r.n for r in hits.collect()} == {1}


def test_empty_table(spark):
    spark.createDataFrame([], "ID int, K int").write.format("jdbc").options(url=DERBY["url"], driver=DERBY["driver"], dbtable="NONE1").save()
    assert planned.read_planned(spark, DERBY, "NONE1", "K", 4).count() == 0
    with pytest.raises(ValueError):
        planned.planned_predicates(spark, DERBY, "x; DROP", "K", 4)
