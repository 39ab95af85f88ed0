"""The registered queries on the smallest tables, and the pipeline step by step."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm import byte_bpe, decontaminate, prob_minhash, robust_outliers, secret_links
from quillon.llm.queries import QUERIES, RANKS
from quillon.session import TABLES
from tests.llm.frames import bounded, listed, odd_documents, wide_documents
from tools.compare import table

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.LLM_SQL])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    result = con.execute(entry.LLM_SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
        frames.append(at)
    good, single, clean, marked = frames
    kept = {r.doc_id for r in robust_outliers.verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    classes = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(good).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    dirty = {r.doc_id for r in decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where(
        "contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - dirty
    found = {r.doc_id: r.spans for r in secret_links.scan(clean).collect()}
    before = {r.doc_id: r for r in clean.collect()}
    for r in marked.collect():
        assert ("[SECRET]" in r.text) == bool(found[r.doc_id])
        assert r.n_chars == (len(r.text) if found[r.doc_id] else before[r.doc_id].n_chars)
    assert listed(corpus_pipeline.run(spark, SF)) == listed(byte_bpe.token_digests(marked, RANKS))


def test_stages_take_odd_rows(spark):
    at = odd_documents(spark, clashes=True)
    columns = at.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == at.count()


def test_stages_take_no_rows(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        assert at.count() == 0


def test_tokens_are_made_of_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "with_python", bounded(byte_bpe.with_python))
    docs = wide_documents(spark)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 1500
