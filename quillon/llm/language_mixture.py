"""Language identification by mixtures: every document is a mixture of languages over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import with_python

#: N-grams are hashed into so many counts per language.
BUCKETS = 1 << 14
#: About this many documents of a language are learned from; of a language with fewer, all.
TRAIN_DOCS = 4000
#: A language is a column of the model, held by every task: this many at most, or the labels are no languages.
MAX_LANGUAGES = 1000
#: N-grams overlap: so many of them count as one observation in the penalty.
OVERLAP = 3
STEPS = 30

NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed trigrams (word ends are spaces) of the whole text; None without a letter."""
    plain = NOT_LETTERS.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, plain)):
        return None
    points = np.frombuffer(f" {plain.strip()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mixed = points[:-2] * np.uint32(0x85EBCA6B) ^ points[1:-1] * np.uint32(0xC2B2AE35) ^ points[2:] * np.uint32(0x27D4EB2F)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount((mixed >> np.uint32(8)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)


def held_out() -> Column:
    """Documents never learned from: crc32 of the doc_id as text is 2 mod 4. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of every n-gram bucket in each.

    Learns from rows with text, language and an id that is not held out: from all rows of a language up to about
    ``train_docs``, beyond from those whose id hashes below the share that makes this number. Counts are summed per
    task first, so what reaches the driver is ``BUCKETS`` numbers per language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return [], np.ones((0, BUCKETS))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, train_docs / r["count"]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = grams(text)
                if found is not None:
                    sums[lang] = sums.get(lang, 0) + found
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                                             names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    summed = sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    counts[found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(dtype=int),
           found["bucket"].to_numpy(dtype=int)] = found["n"].to_numpy(dtype=float)
    seen = counts.sum(axis=1) > 0
    counts = counts[seen] + 0.5
    return [lang for lang, s in zip(languages, seen) if s], counts / counts.sum(axis=1, keepdims=True)


def mixture(counts: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation and their log likelihood. ``likely``: languages x n-grams."""
    share = np.full(len(likely), 1.0 / len(likely))
    total = counts.sum()
    for _ in range(STEPS):
        # expectation: which language each n-gram came from; maximisation: the mean over the document
        after = share * (likely @ (counts / (share @ likely))) / total
        done = np.abs(after - share).max() < 1e-3
        share = after
        if done:
            break
    return share, float(counts @ np.log(share @ likely))


def infer(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language indices and their proportions, the largest first.

    All languages are fitted together; then sets of the largest 1, 2, ... are compared by likelihood less half a logarithm
    of the observations for every further language, until a further language no longer pays.
    """
    at = np.flatnonzero(counts)
    x, likely = counts[at].astype(float), model[:, at]
    alone = np.log(likely) @ x
    order = [int(np.argmax(alone))]
    share, best = np.ones(1), alone[order[0]] / OVERLAP
    fine = np.log(max(2.0, x.sum() / OVERLAP)) / 2
    if len(model) > 1:
        every, _ = mixture(x, likely)
        ranked = [int(i) for i in np.argsort(-every, kind="stable") if i != order[0]]
        for extra in ranked:
            proposal = [*order, extra]
            fitted, value = mixture(x, likely[proposal])
            if value / OVERLAP - fine * len(order) <= best:
                break
            order, share, best = proposal, fitted, value / OVERLAP - fine * len(order)
    by_share = np.argsort(-share, kind="stable")
    return np.array(order)[by_share], share[by_share]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), ``lang_pred, score`` and ``languages``, the set with its proportions.

    Only the whole text is looked at. ``und`` with score 0 for a null text, one without a letter, or an empty model.
    """
    languages, likely = model
    likely = likely.astype(np.float32).astype(float)

    def run(texts: list[str | None]) -> Iterator[tuple]:
        for text in texts:
            counts = grams(text) if languages else None
            if counts is None:
                yield "und", 0.0, []
                continue
            chosen, share = infer(counts, likely)
            yield (languages[chosen[0]], round(float(min(1.0, share[0])), 6),
                   [{"lang": languages[i], "share": round(float(s), 6)} for i, s in zip(chosen, share)])

    each = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    return with_python(docs, ["text"], {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()),
                                        "languages": ("array<struct<lang:string,share:double>>", each)}, run, keep)


def predictions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every row, learned and predicted; equal rows get equal ones."""
    return identify(docs, learn(docs, train_docs), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score",
        F.array_join(F.transform("languages", lambda s: F.concat_ws(":", s["lang"], s["share"])), ",").alias("languages"))
