import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import robust_outliers
from quillon.llm.text_stats import text_stats
from tests.llm.frames import bounded, listed, no_documents, odd_documents, wide_documents


def brute_counts(text):
    text = text or ""
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_counts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n#é\x0b\x1f<\x85") for _ in range(rng.randrange(60)))
        assert text_stats(text) == brute_counts(text)
    assert text_stats(None) == (0, 0, 0, 0, 0)


def prose(rng, n, words=("river", "mill", "candle", "children", "evening", "blanket", "supper", "village", "water", "bell")):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def corpus(spark, junk=30):
    rng, rows = random.Random(3), []
    for i in range(400):
        rows.append((i, prose(rng, rng.randrange(60, 300)), ["en", "de"][i % 2], "hot" if i % 3 else "cold"))
    for i in range(junk):
        rows.append((1000 + i, " ".join(w + "###" for w in prose(rng, 90).split()), "en", "hot"))
    rows += [(2000, prose(rng, 30), "en", "hot"), (2001, "again and again " * 40, "en", "hot"), (2002, prose(rng, 100), None, None),
             (2003, prose(rng, 100), "rare", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_junk_goes_and_prose_stays(spark):
    out = {r.doc_id: r for r in robust_outliers.verdicts(corpus(spark)).collect()}
    assert all(out[i].kept for i in range(400))
    assert not any(out[i].kept for i in range(1000, 1030))
    assert out[2000].base_failed and out[2001].base_failed and not out[2001].kept
    # no language has so few rows that its rows are not judged: they take the estimate of the table
    assert out[2002].kept and out[2002].distance is not None and out[2003].kept


def test_small_languages_are_judged(spark):
    rng = random.Random(3)
    rows = [(9000, " ".join(w + "###" for w in prose(rng, 90).split()), "rare", "x"), (9001, prose(rng, 90), "rare", "x")]
    docs = corpus(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = {r.doc_id: r.kept for r in robust_outliers.verdicts(docs).where("doc_id >= 9000").collect()}
    assert out == {9000: False, 9001: True}


def test_copies_count_once(spark):
    rows = [(9000 + i, prose(random.Random(1), 150), "en", "hot") for i in range(1500)]
    docs = corpus(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = {r.doc_id: r.kept for r in robust_outliers.verdicts(docs).collect()}
    assert all(out[i] for i in range(400)) and not any(out[i] for i in range(1000, 1030)) and out[9000]


def pairs_of_counts(spark, odd):
    """Counts whose rates of symbols and of repeated lines rise and fall together, and some rows beside."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        level = rng.uniform(2.5, 6.0)
        counts = [max(0, int(np.exp(level + rng.normal(0, 0.05)))) for _ in range(2)]
        rows.append((i, "en", "s", 1000, 5000 + int(rng.normal(0, 200)), *counts, 6 * rng.integers(2, 8)))
    rows = [tuple(int(v) if not isinstance(v, str) else v for v in r) for r in rows + odd]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
                                       "n_dup_lines long, n_repeat_words long")


def test_a_pair_is_an_outlier_though_its_values_are_not(spark):
    # each value lies well within the rows; together they do not
    odd = [(9000, "en", "s", 1000, 5000, 300, 15, 24), (9001, "en", "s", 1000, 5000, 15, 300, 24), (9002, "en", "s", 1000, 5000, 300, 300, 24),
           (9003, "en", "s", 1000, 5000, 15, 15, 24)]
    counts = pairs_of_counts(spark, odd)
    models = robust_outliers.fit_all(counts)
    out = {r.doc_id: r.kept for r in robust_outliers.judge(counts, models).collect()}
    assert (out[9000], out[9001], out[9002], out[9003]) == (False, False, True, True)
    assert sum(out[i] for i in range(600)) >= 595
    # the estimate decides: with floors in its place, or without its correlations, the verdicts are others
    floors = [1 / robust_outliers.FLOOR if i == j else 0.0 for i in range(4) for j in range(i + 1)]
    floored = tuple(m.withColumn("white", F.array(*map(F.lit, floors))) for m in models)
    assert sum(r.kept for r in robust_outliers.judge(counts, floored).collect()) < 50
    spread = np.asarray(counts.select(*robust_outliers.vector()).collect()).std(axis=0)
    alone = [1 / spread[i] if i == j else 0.0 for i in range(4) for j in range(i + 1)]
    single = tuple(m.withColumn("white", F.array(*map(F.lit, map(float, alone)))) for m in models)
    assert all(r.kept for r in robust_outliers.judge(counts, single).where("doc_id >= 9000").collect())


def test_no_direction_of_the_given_tables_is_at_the_floor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = robust_outliers.fit_all(robust_outliers.measure(docs, ["lang", "source"]))
    for model in models:
        for row in model.where(F.col("rows") >= robust_outliers.MIN_ROWS).collect():
            white = np.zeros((4, 4))
            white[np.tril_indices(4)] = row.white
            assert np.linalg.eigvalsh(np.linalg.inv(white.T @ white)).min() > 100 * robust_outliers.FLOOR ** 2


def test_estimate_withstands_a_third_of_junk(spark):
    out = {r.doc_id: r for r in robust_outliers.verdicts(corpus(spark, junk=60)).collect()}
    assert all(out[i].kept for i in range(400)) and not any(out[i].kept for i in range(1000, 1060))


def test_each_statistic_rejects_by_itself(spark):
    rng = random.Random(5)
    clean = [(i, prose(rng, rng.randrange(60, 300)), "en", "s") for i in range(200)]
    plain = [f"w{i:04d}" for i in range(100)]
    phrase = plain[:22]
    planted = {1000: " ".join(w * 3 for w in plain), 1001: " ".join(w + "#" * (i % 3) for i, w in enumerate(plain)),
               1002: "\n".join(" ".join(plain[i:i + 8]) + "\nthe end" for i in range(0, 80, 8)),
               1003: " ".join(phrase + plain[30:60] + phrase + plain[60:86])}
    counts = {i: brute_counts(t) for i, t in planted.items()}
    assert counts[1002][3] == 9 and counts[1002][4] == 0 and counts[1003][3] == 0 and counts[1003][4] == 44
    docs = spark.createDataFrame(clean + [(i, t, "en", "s") for i, t in planted.items()], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in robust_outliers.verdicts(docs).collect()}
    assert all(out[i].kept for i in range(200))
    assert not any(out[i].base_failed or out[i].kept for i in planted)


def brute_mcd(points, trials=300):
    """The best core of many random starts, each taken to its end by concentration steps."""
    rng, half, best = np.random.default_rng(0), int(np.ceil(len(points) * robust_outliers.CORE)), np.inf
    for _ in range(trials):
        core = points[rng.choice(len(points), 8, replace=False)]
        for _ in range(30):
            cov = np.cov(core.T, bias=True)
            off = points - core.mean(axis=0)
            core = points[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[:half]]
        best = min(best, np.linalg.slogdet(np.cov(core.T, bias=True))[1])
    return best


def test_determinant_against_random_starts(spark):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.multivariate_normal([1, 2, 0, 1], np.diag([.2, .5, 1, .1]) + .05, 300),
                        rng.multivariate_normal([4, 4, 4, 4], np.eye(4) * .1, 100)])
    frame = spark.createDataFrame([("g", *map(float, p)) for p in points], "lang string, x0 double, x1 double, x2 double, x3 double")
    found = robust_outliers.fit(frame, ["lang"]).first()
    assert found.rows == 400 and found.log_det <= brute_mcd(points) + 0.15  # the last histogram bin may be in the core
    assert np.abs(np.array(found.centre) - [1, 2, 0, 1]).max() < 0.35


def test_verdicts_follow_the_distance(spark):
    counts = robust_outliers.measure(corpus(spark), ["doc_id", "lang", "source"])
    models = robust_outliers.fit_all(counts)
    fine = {(r.lang, r.source): r for r in models[0].collect()}
    points = {r.doc_id: r.x for r in counts.select("doc_id", F.array(*robust_outliers.vector()).alias("x")).collect()}
    for row in robust_outliers.judge(counts, models).where("distance is not null and lang = 'en'").collect():
        model = fine[row.lang, row.source]
        white = np.zeros((4, 4))
        white[np.tril_indices(4)] = model.white
        x = points[row.doc_id]
        counts = np.array([row.n_symbols, row.n_dup_lines, row.n_repeat_words / 6]) + 1
        bare = [np.log(row.word_chars / row.n_words), *np.log(counts / row.n_words)]
        assert np.all(np.abs(np.array(x) - bare) <= np.array([1e-9, *(0.4 * 3.5 / np.sqrt(counts))]))
        assert row.distance == pytest.approx(np.square(white @ (np.array(x) - model.centre)).sum(), rel=1e-6, abs=1e-9)
        assert row.kept == (row.distance <= robust_outliers.CUTOFF)
    assert robust_outliers.chi2_4_tail(robust_outliers.CUTOFF) == pytest.approx(robust_outliers.TAIL)


def test_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    out = robust_outliers.verdicts(docs)
    want = sorted(((r.doc_id, *brute_counts(r.text)) for r in docs.collect()), key=str)
    assert listed(out, "doc_id", *robust_outliers.COUNTS) == want
    kept = robust_outliers.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == out.where("kept").count()
    assert kept.where(F.col("kept") != "own kept").count() == 0


def test_no_documents(spark):
    assert robust_outliers.verdicts(no_documents(spark)).count() == 0
    assert robust_outliers.filter_documents(no_documents(spark)).count() == 0


def test_texts_are_counted_once_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(robust_outliers, "with_python", bounded(robust_outliers.with_python))
    plan = robust_outliers.filter_documents(wide_documents(spark))
    assert plan.count() > 0
    assert "MapInArrow" not in plan._jdf.queryExecution().toString()
