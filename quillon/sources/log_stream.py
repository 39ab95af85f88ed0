"""An append-only log behind an address as a stream with offsets of its own: start, replay, and a limit per batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillon.sources.rest import _get, _load


def http_log(options: dict, part: str | None, start: int, end: int):
    """``endpoint/ends`` answers the end of every part; ``endpoint/part?start=&end=`` the records between two offsets."""
    base, headers = options["endpoint"].rstrip("/"), json.loads(options.get("headers", "{}"))
    return _get(f"{base}/ends" if part is None else f"{base}/{part}?start={start}&end={end}", headers)


class Piece(InputPartition):
    """The records of a part from ``start`` up to, without, ``end``."""

    def __init__(self, part: str, start: int, end: int):
        super().__init__(None)
        self.part, self.start, self.end = part, start, end


class LogStreamReader(DataSourceStreamReader):
    """Offsets are a number per part of the log. Spark writes a batch's range before it reads it, so a batch that is run
    again reads the same records.

    A limit per batch needs to know where the last one ended. Spark doesn't say so to a reader that has just started, so
    the end of each finished batch is kept in ``progress``; a batch that was planned but not finished comes again
    through ``partitions`` before the next is asked for.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.fetch = _load(options.get("fetcher", "quillon.sources.log_stream:http_log"))
        self.limit = int(options.get("records_per_batch", "0"))
        self.piece = int(options.get("records_per_task", "100000"))
        if self.limit and not options.get("progress"):
            raise ValueError("records_per_batch needs a progress folder")
        self.at: dict[str, int] | None = None

    def _progress(self) -> tuple[pyarrow.fs.FileSystem, str]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.options["progress"] if "://" in self.options["progress"]
                                                     else f"file://{self.options['progress']}")
        return store, f"{path}/committed.json"

    def _ends(self) -> dict[str, int]:
        return {str(k): int(v) for k, v in self.fetch(self.options, None, 0, 0).items()}

    def initialOffset(self) -> dict:
        self.at = {} if self.options.get("start", "earliest") == "earliest" else self._ends()
        return self.at

    def latestOffset(self) -> dict:
        ends = self._ends()
        if not self.limit:
            return ends
        at = self.at
        if at is None:
            store, path = self._progress()
            if store.get_file_info(path).type == pyarrow.fs.FileType.File:
                at = json.loads(store.open_input_stream(path).read())
        at = at or {}
        # the limit goes to the parts by what they have, at least one record each
        waiting = {p: ends[p] - at.get(p, 0) for p in ends}
        total = sum(waiting.values())
        share = 1 if total <= self.limit else self.limit / total
        self.at = {p: at.get(p, 0) + (n if share == 1 else min(n, max(1, int(n * share)))) for p, n in waiting.items()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.limit:
            self.at = {p: max(n, (self.at or {}).get(p, 0)) for p, n in end.items()}
        return [Piece(p, first, min(first + self.piece, n)) for p, n in sorted(end.items())
                for first in range(start.get(p, 0), n, self.piece)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        records = self.fetch(self.options, partition.part, partition.start, partition.end)
        n = 0
        for n, record in enumerate(records, 1):
            yield partition.part, partition.start + n - 1, record if isinstance(record, str) else json.dumps(record)
        if n != partition.end - partition.start:
            raise ValueError(f"part {partition.part} has {n} records from {partition.start} to {partition.end}: the log has lost some")

    def commit(self, end: dict) -> None:
        if self.limit:
            store, path = self._progress()
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path + ".new") as out:
                out.write(json.dumps(end).encode())
            store.move(path + ".new", path)


class LogDataSource(DataSource):
    """``spark.readStream.format("log")`` with ``endpoint``, ``start`` (``earliest`` or ``latest``), ``records_per_batch`` with
    ``progress`` (a shared folder), ``records_per_task`` and ``fetcher`` (``module:function`` in place of :func:`http_log`)."""

    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return "part string, offset long, value string"

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogDataSource)
