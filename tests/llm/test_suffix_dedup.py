import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffix_dedup
from tests.llm.frames import listed, no_documents, odd_documents


def brute(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i:i + size] for d in texts for i in range(len(d) - size + 1))
    out = []
    for (doc_id, _), d in zip(rows, texts):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - size + 1):
            if counts[d[i:i + size]] > 1:
                gone[i:i + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdé ") for _ in range(120))
    out = [None, "", "a" * 50, "ab" * 40, "xyz", base, base, base[:50] + "Q" + base[50:]]
    for _ in range(50):
        a, b = sorted(rng.sample(range(120), 2))
        out.append("".join(rng.choice("abc") for _ in range(rng.randrange(30))) + base[a:b] + rng.choice("pqr"))
    return [*enumerate(out), (None, out[20]), (30, out[30]), (3, "other " + base[10:60])]


@pytest.mark.parametrize("size,hot", [(12, 5000), (12, 3), (20, 3), (7, 2), (1, 5000)])
def test_against_brute_force(spark, size, hot):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert listed(suffix_dedup.deduplicate(frame, size, hot=hot)) == brute(rows, size)


def test_test_tables_at_full_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert listed(suffix_dedup.deduplicate(docs)) == brute(rows, 200)
    assert listed(suffix_dedup.deduplicate(docs, hot=2)) == brute(rows, 200)


def test_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 5000 else r.text[:5000]) for r in docs.collect()]
    short = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(suffix_dedup.deduplicate(short)) == brute(rows, 200)
    assert suffix_dedup.deduplicate(docs).count() == docs.count()


def test_every_window_has_one_anchor(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    data = np.frombuffer(random.Random(1).randbytes(1000), np.uint8) % 3
    _, places, firsts, runs = suffix_dedup.anchors(data, 30)
    assert runs.sum() == 1000 - 30 + 1 and firsts[0] == 0
    assert (firsts[1:] == firsts[:-1] + runs[:-1]).all()
    assert (places >= firsts + runs - 1).all() and (places + suffix_dedup.anchor_bytes(30) <= firsts + 30).all()


def test_kept_bytes(spark):
    rows = [(1, "x" + "hello world " * 3 + "y"), (2, "something else entirely, with hello world hello in it")]
    out = {r.doc_id: r for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 10,
                                                         keep_bytes=True).collect()}
    for doc_id, text in rows:
        left = bytes(out[doc_id].kept) if out[doc_id].kept is not None else text.encode()
        assert hashlib.sha256(left).hexdigest() == out[doc_id].kept_sha256


def test_no_documents(spark):
    assert suffix_dedup.deduplicate(no_documents(spark)).count() == 0
