"""Events seen once, and sessions of a key: by Spark's session windows, or as state that a key keeps while its session runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sessions of a task merge before the shuffle, so that a key with very many events is few rows.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"

Span = tuple[int, int, int, float]


def timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """The stream with event time ``ts``; rows later than ``watermark`` behind the newest are dropped by stateful operators."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def seen_once(df: DataFrame, ids: list[str]) -> DataFrame:
    """A :func:`timed` stream without events that were sent again within the watermark. An id is forgotten when the
    watermark passes it, so the state holds the ids of that time alone."""
    return df.dropDuplicatesWithinWatermark(ids)


def session_totals(df: DataFrame, ts: str, by: list[str], gap: str, value: str | None = None) -> DataFrame:
    """``*by, session_start, session_end, events[, total]`` of a :func:`timed` stream, once for every session that is over.

    A session of a key ends when no event came for ``gap``. It is emitted when the watermark passes its end, which
    also drops its state. ``session_end`` is the last event's time plus ``gap``. Rows without a time or key are no events.
    """
    df.sparkSession.conf.set(LOCAL_MERGE, "true")
    cells = [F.count("*").alias("events")] + ([F.sum(value).alias("total")] if value else [])
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (ts, *by)))
    return known.groupBy(F.session_window(ts, gap).alias("session"), *by).agg(*cells).select(
        *by, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
        "events", *(["total"] if value else []))


def merged_spans(spans: list[Span], times: np.ndarray, values: np.ndarray, gap: int) -> list[Span]:
    """Sessions ``(first, last, events, total)`` after more events: what lies within ``gap`` of each other is one."""
    if len(times):
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(times) > gap)))
        ends = np.append(starts[1:], len(times))
        fresh = zip(times[starts], times[ends - 1], ends - starts, np.add.reduceat(values, starts))
        spans = spans + [(int(a), int(b), int(n), float(t)) for a, b, n, t in fresh]
    out: list[Span] = []
    for first, last, events, total in sorted(spans):
        if out and first - out[-1][1] <= gap:
            before = out.pop()
            out.append((before[0], max(before[1], last), before[2] + events, before[3] + total))
        else:
            out.append((first, last, events, total))
    return out


def keyed_sessions(df: DataFrame, ts: str, by: str, value: str, gap_seconds: int) -> DataFrame:
    """The sessions of :func:`session_totals` by an operator with state of its own: ``by, session_start, session_end, events, total``.

    A key keeps the sessions that may still grow, four numbers each, also while events come out of order; batches of
    events are merged into them as they arrive and are not gathered. A timer at the watermark closes a session, emits
    it and gives its state back. ``by`` is a whole number; a missing value counts as 0.
    """
    gap = gap_seconds * 1_000_000
    known = df.where(f"`{ts}` IS NOT NULL AND `{by}` IS NOT NULL").select(
        F.col(by).cast("long").alias(by), ts, F.unix_micros(ts).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans: list[Span] = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            spans = merged_spans(spans, batch["at"].to_numpy(), batch["value"].to_numpy(), gap)
        mark = state.getCurrentWatermarkMs() * 1000
        over = [s for s in spans if s[1] + gap <= mark]
        spans = [s for s in spans if s[1] + gap > mark]
        if spans:
            state.update(tuple(list(c) for c in zip(*spans)))
            state.setTimeoutTimestamp((min(s[1] for s in spans) + gap) // 1000 + 1)
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame({by: [key[0]] * len(over), "first": [s[0] for s in over], "last": [s[1] + gap for s in over],
                                "events": [s[2] for s in over], "total": [s[3] for s in over]})

    out = known.groupBy(by).applyInPandasWithState(
        run, f"`{by}` long, first long, last long, events long, total double",
        "firsts array<long>, lasts array<long>, events array<long>, totals array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(by, F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("session_end"), "events", "total")


def run_appended(df: DataFrame, sink: str, checkpoint: str, available_now: bool = False, interval: str = "30 seconds"):
    """Append a stream's rows to parquet, every batch in its own folder that a retry overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
