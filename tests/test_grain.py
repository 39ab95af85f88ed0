"""Minimal keys against trying every set of columns."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillon.operators import grain


def brute(records, names, size=3):
    keys = []
    for n in range(1, size + 1):
        for s in combinations(sorted(names), n):
            at = [names.index(c) for c in s]
            if not any(set(k) <= set(s) for k in keys) and len({tuple(r[i] for i in at) for r in records}) == len(records):
                keys.append(s)
    return keys


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("first", [5, 50_000])
def test_against_every_set(spark, monkeypatch, seed, first):
    monkeypatch.setattr(grain, "FIRST_ROWS", first)
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    records = list({tuple(rng.choice([None, *range(w)]) for w in (3, 5, 4, 9)) for _ in range(rng.choice([3, 12, 40]))})
    df = spark.createDataFrame(records, "a int, b int, c int, d int")
    assert grain.minimal_keys(df) == brute(records, names)


def test_composite_key_of_lines(spark):
    df = spark.range(3000).select((F.col("id") % 600).alias("order"), F.floor(F.col("id") / 600).alias("line"), F.lit(1).alias("one"),
                                  (F.col("id") * 1.5).alias("price"), F.array("id").alias("list"))
    assert grain.groupable(df) == ["order", "line", "one"]
    assert grain.minimal_keys(df) == [("line", "order")]


def test_few_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert grain.minimal_keys(df) == [("a",), ("b",)] and grain.minimal_keys(df.where("a > 1")) == [("a",), ("b",)]
    assert grain.minimal_keys(df.union(df)) == []
    assert [tuple(r) for r in grain.grains({"t": df}).collect()] == [("t", "a", 1), ("t", "b", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_shares_of_tuples_and_small_tasks_against_every_set(spark, monkeypatch, seed):
    for name, value in {"FIRST_ROWS": 5, "SCREEN_TUPLES": 20, "TUPLES_A_TASK": 30, "SETS_A_PASS": 3}.items():
        monkeypatch.setattr(grain, name, value)
    rng = random.Random(100 + seed)
    names = ["a", "b", "c", "d"]
    records = list({tuple(rng.choice([None, *range(w)]) for w in (4, 6, 7, 12)) for _ in range(90)})
    df = spark.createDataFrame(records, "a int, b int, c int, d int")
    assert grain.minimal_keys(df) == brute(records, names)


def test_sets_that_repeat_often_are_not_shuffled_whole(spark, monkeypatch):
    for name, value in {"FIRST_ROWS": 10, "SCREEN_TUPLES": 500}.items():
        monkeypatch.setattr(grain, name, value)
    tested, test = [], grain._without_repeats

    def spy(df, sets, share=1, rows=None):
        tested.extend((s, share, rows) for s in sets)
        return test(df, sets, share, rows)

    monkeypatch.setattr(grain, "_without_repeats", spy)
    # the first rows repeat in no column, a hundred do in "most"
    df = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 3900).alias("most"))
    assert grain.minimal_keys(df) == [("id",)]
    assert {s for s, share, _ in tested if share > 1} == {("most",), ("id",)}
    assert [(s, rows) for s, _, rows in tested if rows is not None] == [(("id",), 4000)]


def test_values_that_change_places_are_other_tuples(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, None), (None, 1), (2, 2), (1, 1)], "a int, b int")
    assert grain.minimal_keys(df) == [("a", "b")]
