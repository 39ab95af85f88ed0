import zlib

import numpy as np

from quillon.llm import language_mixture as lm
from tests.llm.frames import listed, no_documents, odd_documents

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = lm.predictions(docs).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(DOCS).limit(300).cache()
    other = docs.withColumn("lang", lm.F.when(lm.held_out(), "xx").otherwise(lm.F.col("lang")))
    assert listed(lm.predictions(docs)) == listed(lm.predictions(other))
    assert "xx" not in lm.learn(other)[0]


def test_sample_has_its_size(spark):
    docs = spark.read.parquet(DOCS)
    languages, model = lm.learn(docs, train_docs=50)
    assert languages == sorted(languages) and np.allclose(model.sum(axis=1), 1)


def test_mixture_finds_the_shares():
    rng = np.random.default_rng(0)
    model = rng.dirichlet(np.full(lm.BUCKETS, 0.05), 5) + 1e-9
    model /= model.sum(axis=1, keepdims=True)
    counts = rng.multinomial(3000, 0.7 * model[1] + 0.3 * model[4])
    chosen, share = lm.infer(counts, model)
    assert chosen.tolist() == [1, 4] and abs(share[0] - 0.7) < 0.05
    alone, one = lm.infer(rng.multinomial(500, model[2]), model)
    assert alone.tolist() == [2] and one.tolist() == [1.0]


def test_expectation_maximisation_reaches_the_best_shares():
    rng = np.random.default_rng(1)
    likely = rng.dirichlet(np.full(40, 0.3), 2) + 1e-6
    counts = rng.multinomial(2000, 0.6 * likely[0] + 0.4 * likely[1])
    share, value = lm.mixture(counts, likely)
    best = max(float(counts @ np.log(s * likely[0] + (1 - s) * likely[1])) for s in np.linspace(0.001, 0.999, 999))
    assert value >= best - 0.5 and abs(share.sum() - 1) < 1e-9


def test_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    out = lm.predictions(docs).collect()
    assert len(out) == docs.count()
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert by_id[0] == by_id[1] == by_id[2] == {"und"} and by_id[5] <= {"en", "de"} and len(by_id[5]) == 1
    whole = lm.identify(docs, lm.learn(docs))
    assert listed(whole, *docs.columns) == listed(docs)


def test_nothing_to_learn_from(spark):
    docs = odd_documents(spark).withColumn("lang", lm.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lm.predictions(docs).collect()} == {("und", 0.0)}
    assert lm.predictions(no_documents(spark)).count() == 0
