"""Keyed write-back: rewritten buckets, versions, writers that fail and writers that meet."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.versioned import KeyedTable, VersionConflict
from tests.conftest import rows


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"))
    made.create(spark.range(200).select("id", (F.col("id") * 2).alias("v")), ["id"], buckets=8)
    return made


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v long")


def test_only_touched_buckets_are_written(spark, table):
    updates = frame(spark, (3, -1), (500, -2))
    touched = table.bucket_of(updates)
    assert table.upsert(updates) == 2
    old, new = table.manifest(1), table.manifest(2)
    assert new["rewritten"] == touched and 1 <= len(touched) <= 2
    assert {b for b in new["buckets"] if old["buckets"].get(b) != new["buckets"][b]} == {str(b) for b in touched}
    assert dict(rows(table.read())) == {**{i: 2 * i for i in range(200)}, 3: -1, 500: -2}
    assert dict(rows(table.read(1))) == {i: 2 * i for i in range(200)}  # the version before is as it was
    assert rows(table.changes(1, 2)) == [("added", 500), ("changed", 3)]


def test_against_a_dict(spark, table):
    rng, want = random.Random(2), {i: 2 * i for i in range(200)}
    for _ in range(4):
        batch = {rng.randrange(300): rng.randrange(1000) for _ in range(15)}
        table.upsert(frame(spark, *batch.items()))
        want |= batch
        gone = rng.sample(sorted(want), 5)
        table.delete(spark.createDataFrame([(g,) for g in gone], "id long"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert dict(rows(table.read())) == want
    assert table.latest() == 9


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, table, monkeypatch):
    def crash(self, manifest):
        raise RuntimeError("power cut")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(KeyedTable, "_publish", crash)
        table.upsert(frame(spark, (1, -1)))
    again = KeyedTable(spark, table.path)
    assert again.latest() == 1 and dict(rows(again.read()))[1] == 2
    with pytest.raises(VersionConflict, match="release"):
        again.upsert(frame(spark, (1, -1)))
    again.release(2)  # its writer is gone
    assert again.upsert(frame(spark, (1, -1))) == 2 and dict(rows(again.read()))[1] == -1


def test_two_writers_of_one_version(spark, table):
    other = KeyedTable(spark, table.path)
    base = other.manifest()
    table.upsert(frame(spark, (1, -1)))
    with pytest.raises(VersionConflict):
        other._commit(base, frame(spark, (2, -2)), [0])
    assert dict(rows(other.read()))[1] == -1 and not [f for f in os.listdir(f"{table.path}/manifests") if f.endswith(".claim")]


def test_last_update_wins_and_nulls_are_a_key(spark, table):
    updates = spark.createDataFrame([(7, 1, 1), (7, 3, 3), (7, 2, 2), (None, 5, 1)], "id long, v long, at long")
    wide = KeyedTable(spark, table.path + "-wide")
    wide.create(updates.where("at = 1"), ["id"], buckets=4)
    wide.upsert(updates.where("id IS NOT NULL"), "at")
    assert rows(wide.read()) == [(None, 5, 1), (7, 3, 3)]
    wide.delete(spark.createDataFrame([(None,)], "id long"))
    assert rows(wide.read()) == [(7, 3, 3)]


def test_empty_tables_and_updates(spark, tmp_path, table):
    none = frame(spark, (1, 1)).where("id < 0")
    assert table.upsert(none) == 1 and table.delete(none) == 1
    empty = KeyedTable(spark, str(tmp_path / "e"))
    empty.create(none, ["id"], 4)
    assert empty.read().count() == 0
    empty.upsert(frame(spark, (1, 1)))
    assert rows(empty.read()) == [(1, 1)]
    with pytest.raises(VersionConflict, match="holds a table"):
        empty.create(none, ["id"])
