"""Sessions and repeated events over several batches, and sketches against exact figures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import sketches
from quillon.streaming import sessions
from tests.conftest import rows

SCHEMA = "id BIGINT, who BIGINT, ts TIMESTAMP, amount DOUBLE"


def stamp(seconds):
    return f"2024-01-{1 + seconds // 86400:02d}T{seconds // 3600 % 24:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}Z"


class Inbox:
    """A folder that a stream reads; each file is a batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def put(self, events):
        self.n += 1
        text = "".join(json.dumps({"id": i, "who": w, "ts": None if t is None else stamp(t), "amount": a}) + "\n" for i, w, t, a in events)
        (self.folder / "in" / f"{self.n:03d}.json").write_text(text)

    def run(self, build):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        query = sessions.run_appended(build(sessions.timed(stream, "ts", "1 hour")), str(self.folder / "out"), str(self.folder / "offsets"), True)
        query.awaitTermination()
        held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        return held[-1] if held else None

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).drop("batch")


def brute_sessions(events, gap, mark):
    out = []
    for who in {w for _, w, t, _ in events if w is not None and t is not None}:
        at = sorted((t, a or 0.0) for _, w, t, a in events if w == who and t is not None)
        runs = []
        for t, a in at:
            if runs and t - runs[-1][-1][0] <= gap:
                runs[-1].append((t, a))
            else:
                runs.append([(t, a)])
        out += [(who, r[0][0], r[-1][0] + gap, len(r), round(sum(a for _, a in r), 6)) for r in runs if r[-1][0] + gap <= mark]
    return sorted(out)


def found(df):
    return sorted((r.who, int(r.session_start.timestamp()), int(r.session_end.timestamp()), r.events, round(r.total, 6)) for r in df.collect())


def shuffled_batches(rng, batches, users=4):
    """Events that are out of order by less than the watermark; every batch is later than the one before."""
    out = []
    for b in range(batches):
        events = [(1000 * b + i, rng.randrange(users), 7200 * b + rng.randrange(3000, 6500), float(rng.randrange(9))) for i in range(25)]
        rng.shuffle(events)
        out.append(events)
    return out


KINDS = {"window": lambda df: sessions.session_totals(df, "ts", ["who"], "900 seconds", "amount"),
         "state": lambda df: sessions.keyed_sessions(df, "ts", "who", "amount", 900)}


@pytest.mark.parametrize("kind", KINDS)
def test_sessions_over_batches_and_restarts(spark, tmp_path, kind):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    box, rng, every, held = Inbox(spark, tmp_path), random.Random(3), [], []
    base = 1704067200  # 2024-01-01 UTC
    for events in shuffled_batches(rng, 5):
        events += [(None, None, 10, 1.0), (None, 1, None, 1.0)]  # no user, no time
        box.put(events)
        every += events
        held.append(box.run(KINDS[kind]))  # every run is a restart from the offsets
    times = [(i, w, None if t is None or b else t, a) for b, (i, w, t, a) in ((False, e) for e in every)]
    mark = max(t for _, _, t, _ in times if t is not None) - 3600
    want = [(w, a + base, b + base, n, s) for w, a, b, n, s in brute_sessions(times, 900, mark)]
    assert found(box.rows()) == want and len(want) > 10
    assert max(held) <= 25 + 10  # sessions behind the watermark have left the state


def test_late_events_do_not_reopen_a_session(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.put([(1, 1, 0, 1.0), (2, 1, 20_000, 1.0)])
    box.run(KINDS["state"])
    box.put([(3, 1, 100, 1.0), (4, 1, 40_000, 1.0)])  # 100 s is hours behind the watermark
    box.run(KINDS["state"])
    assert [(n, s) for _, _, _, n, s in found(box.rows())] == [(1, 1.0), (1, 1.0)]


def test_events_sent_again_are_dropped_while_they_are_remembered(spark, tmp_path):
    box = Inbox(spark, tmp_path)

    def build(df):
        return sessions.seen_once(df, ["id"])

    box.put([(1, 1, 0, 1.0), (1, 1, 5, 1.0), (2, 1, 10, 1.0)])
    assert box.run(build) >= 2
    box.put([(2, 1, 20, 1.0), (3, 1, 30_000, 1.0)])
    box.run(build)
    assert rows(box.rows().select("id")) == [(1,), (2,), (3,)]
    box.put([(4, 1, 60_000, 1.0)])
    assert box.run(build) <= 2  # the ids of hours ago are forgotten


def test_spans_merge_in_any_order():
    rng = random.Random(5)
    for _ in range(200):
        times = [rng.randrange(300) for _ in range(rng.randrange(1, 40))]
        cut = rng.randrange(len(times) + 1)
        spans = []
        for part in (times[:cut], times[cut:]):
            spans = sessions.merged_spans(spans, np.array(part, np.int64), np.ones(len(part)), 7)
        want = brute_sessions([(0, 1, t, 1.0) for t in times], 7, 10 ** 9)
        assert [(a, b + 7, n, t) for a, b, n, t in spans] == [w[1:] for w in want]


def test_sketches_merge_to_the_sketch_of_all(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("name"), F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(
        F.col("id") / 3).alias("x"), F.lit(None).cast("string").alias("none"))
    parts = [sketches.sketch_columns(df.where(f"id % 5 = {i}")) for i in range(5)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    got = {r.column: r for r in sketches.sketch_report(sketches.merge_sketches(merged)).collect()}
    assert [(got[c].row_count, got[c].null_count) for c in ("id", "name", "x", "none")] == [(20_000, 0), (20_000, 0), (20_000, 5_000), (20_000, 20_000)]
    for column, exact in (("id", 20_000), ("name", 700), ("x", 15_000)):
        assert abs(got[column].unique_count - exact) <= sketches.distinct_error() * exact
    assert got["none"].unique_count == 0 and got["none"].median is None and got["none"].top_values == []
    for column, q, at in (("id", 0.25, got["id"].p25), ("id", 0.5, got["id"].median), ("id", 0.75, got["id"].p75)):
        assert abs(at / 20_000 - q) <= 2 * sketches.RANK_ERROR
    assert (got["x"].min_number, got["x"].max_number) == (1 / 3, 19_999 / 3)
    # 700 values fit the sketch, so counts are exact
    assert [t.rows for t in got["name"].top_values] == [29] * 10


def test_sketches_of_no_rows(spark):
    assert sketches.sketch_columns(spark.range(0)).count() == 0
