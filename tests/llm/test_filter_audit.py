"""The audit against counting every document in every order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit
from quillon.llm.filter_audit import FILTERS, ORDERS, STEPS, packed, text_mask, unpacked
from tests.llm.frames import LONG, PROSE, listed, no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """The report of (doc_id, text, lang) rows by its definition."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        known.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in {k[0] for k in known}:
        rows = [k[1:] for k in known if k[0] == part]
        removed = {}
        for order in map("".join, permutations(FILTERS)):
            for step, f in enumerate(order, 1):
                removed[order, step] = sum(f in r and not set(order[:step - 1]) & r for r, _, _ in rows)
        for (order, step), n in removed.items():
            f, before = order[step - 1], set(order[:step - 1])
            here = [(r, g, t) for r, g, t in rows if f in r and not before & r]
            out.append((part, order, step, sum(not (before | {f}) & r for r, _, _ in rows), n,
                        sum(f in r and bool(before & r) for r, _, _ in rows), sum(r == {f} for r, _, _ in rows),
                        sum(g for _, g, _ in here), sum(t for _, _, t in here),
                        sum(m for (o, s), m in removed.items() if o[s - 1] == f)))
    return sorted(out)


def result(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())


def test_odd_documents_against_counting(spark):
    for clashes in (False, True):
        docs = odd_documents(spark, clashes)
        rows = [(5, 1, 0), (6, 0, 1), (6, 1, None), (0, None, None), (None, 1, 1), (999, 1, 1), (4, 1, 1)]
        labels = spark.createDataFrame(rows, LABELS).withColumns({"text": F.lit("own"), "n": F.lit(7)})
        expected = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], rows)
        assert result(docs, labels) == expected


def test_copies_over_parts_and_ids(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    rows = [(i, [prose, prose + " #", "A" * 30, LONG][i % 4], ["en", "de", "", None][i % 3]) for i in range(40)]
    rows += [(3, prose, "en"), (3, prose, "fr"), (None, prose, "en"), (None, prose, "en"), (-5, "", "en"), (-6, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(30)], LABELS)
    assert result(docs, labels) == brute(rows, [tuple(r) for r in labels.collect()])


def test_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    assert result(no_documents(spark), labels) == []
    one = spark.createDataFrame([(1, PROSE, None)], "doc_id long, text string, lang string")
    assert result(one, labels) == brute([(1, PROSE, None)], [])


@pytest.mark.parametrize("mask", [0, 1, 6, 31])
def test_fields_never_run_over(mask):
    many = 2 ** 62 - 1
    total = packed(mask, True, False) * many + packed(0, False, False)
    sums = unpacked(total)
    assert set(sums.ravel().tolist()) <= {0, 1, many, many + 1}
    assert sums.shape[0] * sums.shape[1] == STEPS and len(ORDERS) == 120
    assert sum(sums[:, :, 1].ravel().tolist()) == (many * len(ORDERS) if mask else 0)


def test_mask_bounds():
    words = [f"w{i}" for i in range(100)]
    assert text_mask(" ".join(words)) == 0 and text_mask(" ".join(words[1:])) == 1
    assert text_mask(" ".join(words[:80] + words[:20])) == 0 and text_mask(" ".join(words[:79] + words[:21])) == 2
    assert text_mask("A" + "b" * 9) == 1 and text_mask("A" + "b" * 8) == 1 | 4
    assert text_mask(None) == 1 and text_mask("|") == 1 | 8
    assert text_mask(" x y ") == 1


def test_order_of_rows_is_free(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 1)], LABELS)
    assert listed(filter_audit.audit(docs.orderBy(F.desc("doc_id")).repartition(3), labels)) == listed(filter_audit.audit(docs, labels))
