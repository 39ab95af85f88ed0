"""A log with offsets as a stream: whole, once, in batches of limited size, over restarts and failures."""

import pytest

from quillon.streaming import runner
from tests.conftest import rows


def append(folder, part, *lines):
    with (folder / f"{part}.log").open("a") as out:
        out.writelines(f'{{"id": {n}}}\n' for n in lines)


def config(folder, **more):
    return {"type": "log", "name": "log", "endpoint": str(folder), "fetcher": "tests.pages:log", "required": ("id",), **more}


def run(spark, cfg, tmp_path, process=lambda df: df):
    query = runner.run_stream(spark, cfg, "id BIGINT", str(tmp_path / "out"), str(tmp_path / "offsets"), {"log": process}, available_now=True)
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def seen(spark, tmp_path):
    return [r[0] for r in rows(spark.read.parquet(str(tmp_path / "out/records")).select("id"))]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_restarts_go_on_where_the_last_batch_ended(spark, folder, tmp_path):
    append(folder, "a", *range(5))
    append(folder, "b", *range(10, 13))
    run(spark, config(folder), tmp_path)
    assert seen(spark, tmp_path) == [0, 1, 2, 3, 4, 10, 11, 12]
    assert run(spark, config(folder), tmp_path) == []  # nothing new
    append(folder, "a", 5, 6)
    append(folder, "c", 20)  # a part that was not there before
    run(spark, config(folder), tmp_path)
    assert seen(spark, tmp_path) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 20]


def test_a_failed_batch_is_replayed_with_the_same_records(spark, folder, tmp_path):
    append(folder, "a", *range(4))

    def broken(df):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        run(spark, config(folder), tmp_path, broken)
    append(folder, "a", 4, 5)  # came between the failure and the restart
    run(spark, config(folder), tmp_path)
    assert seen(spark, tmp_path)[:4] == list(range(4))
    run(spark, config(folder), tmp_path)
    batches = rows(spark.read.parquet(str(tmp_path / "out/records")).select("batch", "id"), "id")
    # the planned batch has its own records, the later ones are in another
    assert batches == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]


def test_the_limit_holds_and_nothing_is_lost(spark, folder, tmp_path):
    append(folder, "a", *range(40))
    append(folder, "b", *range(100, 110))
    cfg = config(folder, batch_size=12, progress=str(tmp_path / "progress"))
    sizes = []

    def count(batch_rows):
        sizes.append(batch_rows.count())
        return batch_rows

    for _ in range(12):  # a run reads to the end that it saw at its start; every run is a restart
        run(spark, cfg, tmp_path, count)
    assert seen(spark, tmp_path) == [*range(40), *range(100, 110)]
    assert max(sizes) <= 12
    append(folder, "b", 110)
    run(spark, cfg, tmp_path, count)
    assert seen(spark, tmp_path) == [*range(40), *range(100, 111)]


def test_tasks_share_a_long_part(spark, folder, tmp_path):
    append(folder, "a", *range(10))
    run(spark, config(folder, records_per_task=4), tmp_path)
    assert sorted(p.name.rsplit("-", 1)[0] for p in folder.glob("read-*"))[:3] == ["read-a-0-4", "read-a-4-8", "read-a-8-10"]
    assert seen(spark, tmp_path) == list(range(10))


def test_from_the_end_and_lost_records(spark, folder, tmp_path):
    append(folder, "a", *range(3))
    run(spark, config(folder, starting_offsets="latest"), tmp_path)
    append(folder, "a", 3)
    run(spark, config(folder, starting_offsets="latest"), tmp_path)
    assert seen(spark, tmp_path) == [3]
    with pytest.raises(Exception, match="progress"):
        runner.read_stream(spark, config(folder, batch_size=3)).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "x")).trigger(availableNow=True).start().awaitTermination()
