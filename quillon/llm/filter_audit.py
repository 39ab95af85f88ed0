"""What each filter does in every order of the filters: counts packed into wide integers, summed and unpacked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import with_python, written

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOL = re.compile(r"[#$%&*|]")
CAPITAL = re.compile(r"[A-Z]+")

ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field. A document adds at most one to a field, and no table has 2^64 rows, so no field runs into the next.
FIELD_BYTES = 8
STEPS = len(ORDERS) * len(FILTERS)
PACKED_BYTES = STEPS * len(COUNTERS) * FIELD_BYTES

REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_mask(text: str | None) -> int:
    """Bits 0 to 3: the filters A to D that a text fails; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    capitals = sum(map(len, CAPITAL.findall(text)))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * len(text)) << 2 | bool(SYMBOL.search(text)) << 3)


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The wide integer of one document: a field of one or zero for each order, step and counter."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(COUNTERS)), f"<u{FIELD_BYTES}")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, here = bool(mask & bit), bool(mask & bit) and not gone
            fields[o, s] = (not gone and not fails, here, fails and gone, mask == bit, here and good, here and toxic)
            gone |= fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The sums of all fields: orders x steps x counters."""
    fields = np.frombuffer(total.to_bytes(PACKED_BYTES, "little"), f"<u{FIELD_BYTES}")
    return fields.reshape(len(ORDERS), len(FILTERS), len(COUNTERS)).astype(np.int64)


def report_rows(part: str, total: int) -> pa.Table:
    """The report of a part: a row per order and step."""
    sums = unpacked(total)
    removed = sums[:, :, COUNTERS.index("removed")]
    order = np.array([[FILTERS.index(letter) for letter in o] for o in ORDERS])
    shapley = np.array([removed[order == f].sum() for f in range(len(FILTERS))])
    columns = {"part": pa.array([part] * STEPS), "filter_order": pa.array(np.repeat(ORDERS, len(FILTERS))),
               "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))}
    columns |= {c: pa.array(sums[:, :, i].ravel()) for i, c in enumerate(COUNTERS)}
    return pa.table(columns | {"shapley": pa.array(shapley[order].ravel())})


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: how many documents of a part fail a set of filters, by their labels.

    A document fails E if its text is that of a row with a smaller doc_id. All rows of a text share bits A to D, so a
    text needs a row for each part and label only: its rows, its smallest id, and the rows that have this id. Every sum
    combines before its shuffle, and only digests and ids are shuffled, so neither a text with very many copies nor a
    large part is a large task.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")

    def run(texts: list[str | None]) -> Iterator[tuple]:
        for text in texts:
            yield text_mask(text), hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()

    outputs = {"mask": ("int", pa.int32()), "digest": ("binary", pa.binary())}
    rows = with_python(rows, ["text"], outputs, run, ["doc_id", "part"])
    rows = written(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks")

    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = rows.where("doc_id is not null").join(judged, "doc_id", "left")
    keys = ["part", "mask", "good", "toxic"]
    texts = known.groupBy("digest", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    texts = written(texts, "texts")
    first = texts.groupBy("digest").agg(F.min("least").alias("first"))
    texts = texts.join(first, "digest")
    kept = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    repeat = 1 << FILTERS.index("E")
    each = texts.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), kept.cast("long").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - kept).alias("n")))))
    nameless = rows.where("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), "mask", "n")
    return each.unionByName(nameless).where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: a row, zeros
    included, for each part, order of the five filters and step of it.

    The parts are the values of ``lang``; null is the empty one. Each mask, with the labels that count, stands for one wide
    integer with a field for every order, step and counter; a part's report is the sum of the integers of its documents (an
    integer times the number of documents that have it), taken apart again. A part has at most 128 such integers,
    whatever its size.

    Null text is empty. Rows that repeat a doc_id and its text are documents of their own, and none of them fails E by the
    other. Rows without a doc_id never fail E, make no other row fail it, and have no labels. Of several labels of a
    doc_id any one counts. Labels of other documents, null labels and other columns are ignored. No documents, no rows.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(packed(mask, good, toxic) * n for mask, good, toxic, n in zip(
            *(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))))
        return report_rows(key[0].as_py(), total)

    return masks(docs, labels).groupBy("part").applyInArrow(run, REPORT)
