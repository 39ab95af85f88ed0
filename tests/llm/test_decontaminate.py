import hashlib
import random
import re

import pytest

from quillon.llm import decontaminate
from tests.llm.frames import PROSE, listed, no_documents, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[tuple(w[i:i + n])] if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, size=10):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = decontaminate.contamination(frame, spark.createDataFrame(items, ITEMS), size)
    return listed(out.drop("text_key"))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = ["The", "the", "Öl", "öl", "x1", "of", "a", "B", "été", "z" * 30]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 14))) for i in range(25)] + [(3, text(12)), (None, text(5)), (90, None), (91, "--"), (92, "öl")]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(40)] + [(50 + i, text(5) + (items[i][1] or "") + text(5)) for i in range(25)]
    docs += [(1, docs[2][1]), (None, docs[3][1]), (5, docs[5][1]), (7, None), (None, None)]
    assert run(spark, docs, items, size) == brute(docs, items, size)


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in range(20)]
    docs = [(i, f"start {items[i % 20][1]} end") for i in range(30)]
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    items = [(1, PROSE), (2, "ａ ß"), (3, "lorem ipsum"), (4, None)]
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    out = decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS))
    assert listed(out.drop("text_key")) == brute(pairs, items)
    clean = decontaminate.clean(docs, spark.createDataFrame(items, ITEMS))
    assert clean.columns == docs.columns
    hits = [(r[0], t) for r, (_, t) in zip(sorted(brute(pairs, items), key=str), sorted(pairs, key=str)) if not r[-1]]
    assert clean.count() == sum(1 for r in brute(pairs, items) if not r[-1]) == len(hits)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, PROSE)], ITEMS)
    assert decontaminate.contamination(no_documents(spark), items).count() == 0
    none = spark.createDataFrame([], ITEMS)
    docs = odd_documents(spark)
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
