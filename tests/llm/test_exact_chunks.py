"""Recipes against comparing whole texts, with names that clash."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import exact_chunks
from tests.llm.frames import LONG, listed, no_documents, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    """``doc_id, keep_id, group_size, sha`` by whole texts, and how many rows of a group stay: always one."""
    groups = {}
    for i, text in docs:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(docs, **options):
    got = exact_chunks.duplicates(docs, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    stay = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in got}) == len(stay) == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_documents(spark, clashes):
    check(odd_documents(spark, clashes))


def test_no_documents(spark):
    assert exact_chunks.duplicates(no_documents(spark)).collect() == []
    assert exact_chunks.distinct_documents(no_documents(spark)).collect() == []


@pytest.mark.parametrize("names", [1, 3])
def test_names_that_clash(spark, names):
    """With one or three names for all chunks only the comparison of chunks tells texts apart."""
    texts = ["alpha, beta, gamma", "alpha, beta, gamme", "beta, alpha, gamma", "ALPHA, beta, gamma", "alpha, beta, gamma, ", LONG, LONG + "x", None, ""]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(25)], "doc_id long, text string")
    check(docs, name=lambda c: F.pmod(F.xxhash64(c), F.lit(names)), least=4, most=16)
    check(docs, name=lambda c: F.pmod(F.xxhash64(c), F.lit(names)), least=1, most=2)


def test_non_ascii_case_stays(spark):
    check(spark.createDataFrame([(1, "É A"), (2, "é a"), (3, "É a"), (4, "İI"), (5, "İi"), (6, "ǅZ")], "doc_id long, text string"))


def test_large_group_without_and_with_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same. " * 400 if i % 3 else f"other {i}") for i in range(600)], "doc_id long, text string")
    check(docs)
    monkeypatch.setattr(exact_chunks, "BROADCAST_IDS", 0)
    check(docs)


def test_recipes_join_to_the_text_and_meet_again(spark):
    body = "".join(f"sentence number {i} says little. " for i in range(400))
    docs = spark.createDataFrame([(1, body), (2, body[:3000] + "INSERTED" + body[3000:])], "doc_id long, text string")
    a, b = exact_chunks.recipes(docs).orderBy("doc_id").collect()
    assert "".join(a.chunks) == body and "".join(b.chunks) == (body[:3000] + "inserted" + body[3000:])
    assert len(set(a.ids) & set(b.ids)) >= len(a.ids) - 4 and len(a.ids) > 10


def test_hot_chunks_are_one_row_a_task(spark):
    docs = spark.createDataFrame([(i, "license, " * 300 + f"{i}") for i in range(300)], "doc_id long, text string")
    plan = exact_chunks.clashes(exact_chunks.recipes(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_distinct_documents_keeps_columns(spark):
    docs = odd_documents(spark, clashes=True)
    kept = exact_chunks.distinct_documents(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    staying = [r for r in exact_chunks.duplicates(docs).collect() if r.kept]
    assert sorted((i, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in got if i is not None) == sorted(
        (r.doc_id, r.text_sha256) for r in staying if r.doc_id is not None)
    assert len(got) == len(staying)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aAé.\n\U0001f600 ", max_size=12), max_size=20))
def test_any_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, least=2, most=5)
    assert listed(exact_chunks.recipes(docs, least=2, most=5).select(F.array_join("chunks", "").alias("t"))) == listed(
        docs.select(exact_chunks.normalised(F.col("text"))))
