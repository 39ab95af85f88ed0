"""Repeated substrings of a minimum length, found by bounded interval expansion and removed from every document.

The textbook method extends intervals of a Burrows-Wheeler transform backwards, breadth first: all strings of one length
that occur twice are found from those of the length before, so common prefixes come by increasing value, and the search stops at the
minimum length. One transform of a whole corpus would be one task, so the windows of the corpus (all strings of the
minimum length, by their starts) are first dealt to groups in a way that equal windows can't part: each window
belongs to the k-mer of least hash in it, its anchor. A window whose anchor's hash occurs once is unique. The
others are expanded, group by group and many groups a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import with_python, written

MIN_BYTES = 200
#: A long text is searched for anchors in parts of so many windows.
PART = 1 << 20
#: Occurrences of an anchor beyond which its windows are dealt again by more of their bytes.
HOT = 5000
#: Windows that are expanded at once in a task, plus those of the last group.
BLOCK = 1_000_000
#: Texts that are fetched by a broadcast of their keys, at most; each key is 16 bytes.
BROADCAST_KEYS = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of the ``size`` bytes from every place, built from those of 1, 2, 4, ... bytes."""
    out, done, span = None, 0, 1
    level, left = data.astype(_U) + _U(1), size
    n = len(data)
    while left:
        if left & 1:
            if out is None:
                out, done = level, span
            else:
                keep = n - done - span + 1
                out = out[:keep] * _U(pow(_BASE, span, 1 << 64)) + level[done:done + keep]
                done += span
        left >>= 1
        if left:
            keep = n - 2 * span + 1
            level = level[:keep] * _U(pow(_BASE, span, 1 << 64)) + level[span:span + keep]
            span *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchor_bytes(size: int) -> int:
    return max(1, size * 64 // 200)


def anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the anchors, and the first start and the number of the windows that belong to each.

    Every start of a window belongs to one anchor; of equal hashes in a window the leftmost counts.
    """
    k = anchor_bytes(size)
    found = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    low = _U((1 << 21) - 1)
    for start in range(0, len(data) - size + 1, PART):
        part = data[start:start + PART + size - 1]
        hashes = mix(string_hashes(part, k))
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=_U)
        place = (sliding_min(ranked, size - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        runs = np.diff(np.append(first, len(place)))
        found.append((hashes[place[first]], place[first] + start, first + start, runs))
    return tuple(np.concatenate(c) for c in zip(*found))


def refined_starts(size: int) -> int:
    """Distances to the anchor that stay together when the windows of a hot one are dealt again."""
    return max(1, size * 16 // 200)


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def read_texts(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_key, n_bytes, text_sha256, hashes`` of every row: the hashes of its anchors."""

    def run(texts: list[str | None]) -> Iterator[tuple]:
        for text in texts:
            data = (text or "").encode()
            hashes = anchors(np.frombuffer(data, np.uint8), size)[0]
            yield text_key(data), len(data), hashlib.sha256(data).hexdigest(), hashes.view(np.int64)

    return with_python(docs, ["text"], {"text_key": ("binary", pa.binary()), "n_bytes": ("long", pa.int64()),
                                        "text_sha256": ("string", pa.string()),
                                        "hashes": ("array<long>", pa.list_(pa.int64()))}, run, ["doc_id"])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``doc_id, text_key`` and more, one row per key) with ``text``. Texts that nobody wants are left out
    before the shuffle while the keys are few enough to broadcast."""
    rows = docs.select(F.col("doc_id").alias("_id"), "text",
                       F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32)).alias("_key"))
    if wanted.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(wanted.select(F.col("text_key").alias("_key"))), "_key", "left_semi")
    found = rows.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    return found.select("text", *wanted.columns)


def contexts_of(data: bytes, hot: dict[int, bool], size: int) -> Iterator[tuple[int, bytes, int, int]]:
    """``(group, bytes, number of windows, first start)`` for the anchors in ``hot``: the bytes of all windows of one.

    The windows of a hot anchor are dealt again: those whose distances to the anchor are within one short range have most
    bytes in common, and those name the group. Equal windows have equal distances, so they stay together.
    """
    near = refined_starts(size)
    hashes, places, firsts, runs = anchors(np.frombuffer(data, np.uint8), size)
    for h, p, f, n in zip(hashes.view(np.int64).tolist(), places.tolist(), firsts.tolist(), runs.tolist()):
        if h not in hot:
            continue
        if not hot[h]:
            yield h, data[f:f + n - 1 + size], n, f
            continue
        for q in range((p - f - n + 1) // near, (p - f) // near + 1):
            low, high = max(f, p - near * q - near + 1), min(f + n - 1, p - near * q)
            core = data[p - near * q:p - near * q - near + 1 + size]
            group = xxhash.xxh3_64_intdigest(core + q.to_bytes(4, "little"), seed=h & 0xFFFFFFFF)
            yield group - (1 << 64) * (group >> 63), data[low:high + size], high - low + 1, low


CONTEXTS = {"group": pa.int64(), "context_key": pa.binary(), "context": pa.binary(), "windows": pa.int32(),
            "text_key": pa.binary(), "starts": pa.list_(pa.int32())}


def contexts(texts: DataFrame, size: int) -> DataFrame:
    """A row per text and distinct context in it: ``CONTEXTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [[] for _ in CONTEXTS], 0
            for text, key, found in zip(*[batch.column(c).to_pylist() for c in ("text", "text_key", "found")]):
                own: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
                for group, context, n, start in contexts_of(text.encode(), {f["hash"]: f["hot"] for f in found}, size):
                    own.setdefault((group, context), (n, []))[1].append(start)
                for (group, context), (n, starts) in own.items():
                    for column, value in zip(out, (group, xxhash.xxh3_128_digest(context), context, n, key, starts)):
                        column.append(value)
                    held += len(context)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, CONTEXTS.values())], [*CONTEXTS])
                    out, held = [[] for _ in CONTEXTS], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, CONTEXTS.values())], [*CONTEXTS])

    return texts.mapInArrow(run, "group long, context_key binary, context binary, windows int, text_key binary, "
                                 "starts array<int>")


def symbol_bytes(size: int) -> int:
    """Bytes of a symbol of the expansion: the largest part of ``size`` up to 40."""
    return max(d for d in range(1, min(size, 40) + 1) if size % d == 0)


def expand(groups: np.ndarray, weights: np.ndarray, parts: list[bytes], windows: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of a block of contexts occurs twice or more: flags, context after context.

    Rows are windows, in the order of their suffixes so far; an interval is a run of rows with the same last bytes. One
    step puts the symbol before in front: rows go, stably, into the order of that symbol, which is what the
    transform's last-to-first mapping does, and intervals part where the symbol or the interval before changes.
    Intervals of one occurrence are dropped at once, as no extension of theirs repeats. After ``size`` bytes,
    the rows that are left are the windows that repeat; their bytes are compared once more. A symbol is several bytes, so
    that a window is a few symbols long; every start of a window has its own phase, so none is missed.
    ``weights`` is in how many places each context occurs.
    """
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum([0] + [len(p) for p in parts[:-1]])
    before = np.concatenate(([0], np.cumsum(windows)[:-1]))
    owner = np.repeat(np.arange(len(parts)), windows)
    start = np.arange(len(owner)) - before[owner] + begin[owner]
    step = symbol_bytes(size)
    symbols = mix(string_hashes(buffer, step))
    interval = np.unique(groups, return_inverse=True)[1][owner]
    rows = np.argsort(interval, kind="stable")
    interval = interval[rows]
    for taken in range(step, size + 1, step):
        symbol = symbols[start[rows] + size - taken]
        order = np.argsort(symbol, kind="stable")
        rows, interval, symbol = rows[order], interval[order], symbol[order]
        fresh = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])))
        interval = np.cumsum(fresh) - 1
        many = np.bincount(interval, weights[owner[rows]]) >= 2
        kept = many[interval]
        rows, interval = rows[kept], interval[kept]
        if not len(rows):
            break
    repeats = np.zeros(len(owner), bool)
    repeats[rows] = True
    # the exact check: a row's bytes are those of the row before in its interval
    span = np.arange(size)
    for at in range(1, len(rows), 50_000):
        some = np.arange(at, min(at + 50_000, len(rows)))
        some = some[interval[some] == interval[some - 1]]
        if (buffer[start[rows[some]][:, None] + span] != buffer[start[rows[some - 1]][:, None] + span]).any():
            raise ValueError("two strings have one hash")
    return repeats


def covered(flags: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Runs of bytes that the flagged windows cover: their starts and ends."""
    at = np.flatnonzero(flags)
    if not len(at):
        return [], []
    breaks = np.flatnonzero(np.diff(at) > size)
    return at[np.concatenate(([0], breaks + 1))].tolist(), (at[np.concatenate((breaks, [len(at) - 1]))] + size).tolist()


def repeats(found: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``group, context_key, low, high``: the byte runs of every context that repeated windows cover."""
    distinct = found.groupBy("group", "context_key").agg(
        F.first("context").alias("context"), F.first("windows").alias("windows"),
        F.sum(F.size("starts")).alias("places"))
    dealt = distinct.repartition("group").sortWithinPartitions("group")
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        group, key, parts, windows, places = zip(*rows)
        windows = np.array(windows)
        flags = expand(np.array(group), np.array(places), list(parts), windows, size)
        out = []
        for i, own in enumerate(np.split(flags, np.cumsum(windows)[:-1])):
            low, high = covered(own, size)
            if low:
                out.append((group[i], key[i], low, high))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          ["group", "context_key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist()
                             for c in ("group", "context_key", "context", "windows", "places")]):
                if windows >= block and row[0] != held[-1][0]:
                    yield solved(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[3]
        if held:
            yield solved(held)

    return dealt.mapInArrow(run, "group long, context_key binary, low array<int>, high array<int>")


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes and number of the maximal runs of the union, and what is left."""
    left, at, removed, spans = [], 0, 0, 0
    for low, high in sorted(runs):
        if low > at or not spans:
            left.append(data[at:low])
            spans += 1
            removed += high - low
            at = high
        elif high > at:
            removed += high - at
            at = high
    return removed, spans, b"".join(left) + data[at:]


def deduplicate(docs: DataFrame, size: int = MIN_BYTES, keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (and the bytes ``kept``).

    Every byte that lies in a string of ``size`` bytes that starts anywhere else too is removed, in the same text or
    another; strings are judged on the input and may overlap. Null is the empty text. Texts shorter than ``size`` stay. Rows
    with equal texts, repeated rows among them, are found by their digest and go whole when they have ``size`` bytes;
    only one of them is searched further. What is left may end inside a character, so it is bytes. An empty table
    gives no rows. With ``keep_bytes``, ``kept`` is null for unchanged rows, whose text it is.
    """
    read = written(read_texts(docs, size), "anchors")
    texts = written(read.where(F.col("n_bytes") >= size).groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")), "texts")
    each = texts.select("text_key", "doc_id", F.explode("hashes").alias("hash"))
    # a table of its own, so that the join shuffles both sides and may split a hash with very many places
    shared = written(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(
        "hash", (F.col("n") > hot).alias("hot")), "shared-hashes")
    wanted = each.join(shared, "hash").groupBy("text_key").agg(
        F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("hash", "hot")).alias("found"))
    found = written(contexts(texts_of(docs, written(wanted, "shared-anchors")), size), "contexts")
    runs = repeats(found, size).alias("r")
    placed = found.select("group", "context_key", "text_key", F.explode("starts").alias("start")).alias("f").join(
        runs, ["group", "context_key"]).select("text_key", F.explode(F.transform(
            F.arrays_zip("low", "high"), lambda r: F.struct((r["low"] + F.col("start")).alias("low"),
                                                            (r["high"] + F.col("start")).alias("high")))).alias("run"))
    # at most a run per window of the text
    spans = placed.groupBy("text_key").agg(F.collect_set("run").alias("runs"))
    # whole copies need no text
    parts = written(spans.join(texts.where("copies = 1").select("text_key", "doc_id"), "text_key"), "runs")

    def run(rows: list[str], all_runs: list[list[dict]]) -> Iterator[tuple]:
        for text, own in zip(rows, all_runs):
            removed, n, left = cut(text.encode(), [(r["low"], r["high"]) for r in own])
            yield removed, n, hashlib.sha256(left).hexdigest(), left if keep_bytes else None

    done = with_python(texts_of(docs, parts), ["text", "runs"], {
        "removed": ("long", pa.int64()), "spans": ("long", pa.int64()), "left_sha256": ("string", pa.string()),
        "left": ("binary", pa.binary())}, run, ["text_key"])
    whole = texts.where("copies > 1").select("text_key", F.lit(None).cast("long").alias("removed"),
                                             F.lit(1).cast("long").alias("spans"),
                                             F.sha2(F.lit("").cast("binary"), 256).alias("left_sha256"),
                                             F.lit(b"" if keep_bytes else None).cast("binary").alias("left"))
    changed = written(whole.union(done), "changed")
    out = read.drop("hashes").join(changed, "text_key", "left").select(
        "doc_id", "n_bytes", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(
            F.coalesce("removed", "n_bytes")).alias("n_removed"), F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("left_sha256", "text_sha256").alias("kept_sha256"), F.col("left").alias("kept"))
    return out if keep_bytes else out.drop("kept")
