"""Places of matches against Python's, and their time in texts of very many matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.llm import secret_links, spans, weak_pii


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 40_000])
def test_running_sums_and_maxima(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(-3, 50) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(spans.running(F.col("v")).alias("s"), spans.running(F.col("v"), lambda a, b: F.greatest(a, b), -100).alias("m")).first()
    sums, maxima, at, top = [], [], 0, -100
    for v in values:
        sums.append(at)
        maxima.append(top)
        at, top = at + v, max(top, v)
    assert row.s == sums and row.m == maxima


def test_spans_and_cuts(spark):
    rng = random.Random(5)
    texts = ["", "x", "12", *("".join(rng.choice("12é \U0001f600x\n") for _ in range(rng.randrange(9000))) for _ in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    places = [(rng.randrange(0, 9000), rng.randrange(0, 5000)) for _ in range(12)]
    cuts = F.array(*[spans.cut(spans.segments(F.col("t")), F.lit(a), F.lit(n)) for a, n in places])
    for text, found, parts in spans.with_spans(df, "t", {"s": ("[12]+", 7)}).select("t", "s", cuts).collect():
        assert [tuple(s) for s in found] == [(7, m.start(), m.end(), m[0]) for m in re.finditer("[12]+", text)]
        assert parts == [text[a:a + n] for a, n in places]


def test_meets_any(spark):
    rng, rows = random.Random(6), []
    for _ in range(200):
        edges = sorted(rng.sample(range(60), 2 * rng.randrange(0, 12)))
        known = [(0, a, b, "") for a, b in zip(edges[::2], edges[1::2])]
        start = rng.randrange(60)
        rows.append((known, (0, start, start + rng.randrange(1, 9), "")))
    df = spark.createDataFrame(rows, f"k array<{spans.SPAN}>, s {spans.SPAN}")
    for known, span, met in df.select("k", "s", spans.meets_any(F.col("k"), F.col("s"))).collect():
        assert met == any(k.start < span.end and span.start < k.end for k in known)


def seconds(action):
    start = time.time()
    action()
    return time.time() - start


@pytest.mark.parametrize(("scan", "line"), [
    (secret_links.scan, "password = abcdefgh{i} at https://host{i}.example/x\n"), (weak_pii.detect, "write to mail{i}@example.org or Mr Adam Smith, {i}\n"),
    (secret_links.redact, "password = abcdefgh{i} at https://host{i}.example/x\n")])
def test_time_grows_with_the_matches(spark, scan, line):
    """Four times the matches, far from sixteen times the time."""
    took = []
    for n in (10_000, 40_000):
        text = "".join(line.format(i=i) for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
        docs.count()
        took.append(min(seconds(lambda: scan(docs).collect()) for _ in range(2)))
        docs.unpersist()
    assert took[1] < 7 * took[0] + 3
