import glob
import json
import os
import random
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.operators.sketches import sketch_report
from quillon.plans import stream_queries
from quillon.plans.operator_queries import EVENT_RECORD
from quillon.session import shared_dir
from quillon.streaming import runner
from tests.conftest import rows

RECORD = "id BIGINT, ts TIMESTAMP, kind STRING"


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"id": i, "ts": f"2024-01-01T0{i % 3}:15:00", "kind": "a" if i % 2 else "b"}) for i in range(9)]
    (folder / "1.txt").write_text("\n".join(lines[:5] + ["{broken", "[1]"]))
    (folder / "2.txt").write_text("\n".join(lines[5:] + ['{"kind": "no id"}']))
    return {"type": "files", "name": "inbox", "format": "text", "path": str(folder), "schema": "value STRING",
            "required": ("id",), "files_per_batch": 1}


def test_bad_records_do_not_stop_the_stream(spark, inbox, tmp_path):
    sink, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    runner.register("inbox", lambda df: df.select("id", F.upper("kind").alias("kind")))
    runner.run_stream(spark, inbox, RECORD, sink, offsets, available_now=True).awaitTermination()
    got = spark.read.parquet(f"{sink}/records")
    assert sorted(r.id for r in got.collect()) == list(range(9)) and {r.kind for r in got.collect()} == {"A", "B"}
    assert got.select("batch").distinct().count() == 2  # a file per batch
    assert sorted(r.value for r in spark.read.parquet(f"{sink}/errors").collect()) == ["[1]", '{"kind": "no id"}', "{broken"]
    # a restart reads nothing twice
    runner.run_stream(spark, inbox, RECORD, sink, offsets, available_now=True).awaitTermination()
    assert spark.read.parquet(f"{sink}/records").count() == 9


def test_unknown_processor(spark, inbox, tmp_path):
    with pytest.raises(KeyError):
        runner.processor("nobody")
    with pytest.raises(KeyError):
        runner.run_stream(spark, {**inbox, "name": "nobody"}, RECORD, str(tmp_path), str(tmp_path / "o"))


def test_counts(spark, inbox, tmp_path):
    decoded = runner.decode(runner.read_stream(spark, inbox), RECORD, ("id",))
    sink = str(tmp_path / "states")
    runner.run_totals(runner.record_counts(decoded), sink, str(tmp_path / "o"), available_now=True).awaitTermination()
    assert rows(runner.newest_state(spark, sink)) == [(9, 3)]


def test_rates_and_lag(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "2024-01-01 00:10:30"), ("2024-01-01 00:50:00", "2024-01-01 00:51:30"),
                                ("2024-01-01 01:00:00", "2024-01-01 01:00:00")], "ts string, got string")
    got = rows(runner.stream_rates(df, "ts", arrived="got"), "window_start")
    assert [(r[0].hour, *r[1:]) for r in got] == [(0, 2, 60.0, 90.0), (1, 1, 0.0, 0.0)]


def test_watermark_drops_the_state_of_old_windows(spark, inbox):
    raw = runner.good_records(runner.decode(runner.read_stream(spark, inbox), RECORD))
    plan = runner.stream_rates(raw, "ts")._jdf.queryExecution().logical().toString()
    assert "EventTimeWatermark" in plan


def test_profiled_batches(spark, inbox, tmp_path):
    records = runner.good_records(runner.decode(runner.read_stream(spark, inbox), RECORD, ("id",)))
    runner.run_profiled(records, str(tmp_path / "p"), str(tmp_path / "o"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p")).select("batch").distinct().count() == 2
    got = {r.column: r for r in sketch_report(runner.merged_sketches(spark, str(tmp_path / "p"))).collect()}
    assert (got["id"].row_count, got["id"].unique_count, got["id"].median, got["kind"].unique_count) == (9, 9, 4.0, 2)
    assert [tuple(t) for t in got["kind"].top_values] == [("b", 5), ("a", 4)]


def test_counted_batches_are_exact(spark, inbox, tmp_path):
    records = runner.good_records(runner.decode(runner.read_stream(spark, inbox), RECORD, ("id",)))
    runner.run_counted(records, str(tmp_path / "p"), str(tmp_path / "o"), available_now=True).awaitTermination()
    got = rows(runner.merged_counts(spark, str(tmp_path / "p")))
    # both batches have both kinds and all three times
    assert got == [("id", 9, 0, 9), ("kind", 9, 0, 2), ("ts", 9, 0, 3)]


def test_publish_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, kind string")
    runner.publish(df, {"type": "files", "path": str(tmp_path / "out")})
    sent = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert [json.loads(v) for v in sent] == [{"id": 1, "kind": "x"}, {"id": 2}]
    cfg = {"type": "files", "format": "text", "path": str(tmp_path / "out"), "schema": "value STRING"}
    stream = runner.read_stream(spark, cfg).select(F.get_json_object("value", "$.id").alias("id"))
    with pytest.raises(ValueError, match="checkpoint"):
        runner.publish(stream, {"type": "files", "path": str(tmp_path / "again")})
    runner.publish(stream, {"type": "files", "path": str(tmp_path / "again")}, str(tmp_path / "o")).awaitTermination()
    assert spark.read.text(str(tmp_path / "again")).count() == 2
    keyed = runner.to_messages(df, "id")
    assert keyed.columns == ["key", "value"]


def test_stream_sources_only(spark):
    with pytest.raises(ValueError, match="not a stream"):
        runner.read_stream(spark, {"type": "postgresql"})


def test_update_mode_drops_state_and_merges(spark, tmp_path):
    folder, sink, keys = tmp_path / "in", str(tmp_path / "states"), ("window_start",)
    folder.mkdir()
    total = 0
    for day in range(1, 7):
        (folder / f"{day}.json").write_text("".join(
            f'{{"ts": "2024-01-{day:02d}T0{h}:00:00"}}\n' for h in range(3)))
        stream = spark.readStream.schema("ts TIMESTAMP").json(str(folder))
        query = runner.run_totals(runner.stream_rates(stream, "ts"), sink, str(tmp_path / "offsets"), True, keys)
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert held[-1] <= 6  # windows of past days are gone
        total += 3
        if day == 3:
            runner.compact_states(spark, sink, keys)
        got = runner.newest_state(spark, sink, keys)
        assert got.count() == total and got.agg({"records": "sum"}).first()[0] == total
    written = spark.read.parquet(sink).count()
    assert written <= 2 * total  # a batch writes what it changed


def test_records_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"b": "y"}',), ("{broken",), (None,)], "value string")
    decoded = runner.decode(raw, "a bigint, b string", ("a",))
    assert [tuple(r) for r in decoded.select("failed", "record.b").collect()] == [(False, "x"), (True, "y"), (True, None), (True, None)]
    good = runner.good_records(decoded)
    # as one expression of every field and check, the parser would run for each of them
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in good.collect()] == [(1, "x")]


def test_a_batch_of_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "ROW_GROUP_BYTES", 1 << 18)
    rng = random.Random(1)
    events = spark.createDataFrame([(i, datetime(2024, 1, 1), rng.randrange(1 << 60), str(rng.random()) * 4, rng.random(), "{}") for i in range(60_000)],
                                   EVENT_RECORD)
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream_queries.batched_events(spark, str(tmp_path), files=1)
    inbox = max(glob.glob(f"{shared_dir(spark)}/inbox-*"), key=os.path.getmtime)
    [file] = glob.glob(f"{inbox}/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1
