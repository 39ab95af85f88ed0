import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import insights, outliers, percentiles, profile, quality
from tests.conftest import rows

EDGE = "const double, one_null double, all_null string, single string, neg_quantity int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([
        (7.0, 1.0, None, "x", -1), (7.0, None, None, "x", 2), (7.0, 3.0, None, "x", 3), (7.0, float("nan"), None, "x", 4),
    ], EDGE)


def test_counts_treat_missing_as_duplicates(edge):
    got = {r.column: r for r in profile.column_counts(edge).collect()}
    assert (got["one_null"].null_count, got["one_null"].unique_count, got["one_null"].duplicate_count) == (2, 2, 2)
    assert (got["all_null"].null_percentage, got["all_null"].unique_count) == (100.0, 0)
    assert got["const"].duplicate_percentage == 75.0
    approx = {r.column: r.unique_count for r in profile.column_counts(edge, approx=True).collect()}
    assert approx == {c: got[c].unique_count for c in got}


def test_numeric_stats_match_pandas(spark):
    rng = np.random.default_rng(7)
    values = rng.gamma(2.0, 3.0, 4000)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    got = profile.numeric_stats(df).first()
    d = values - values.mean()
    assert got["mean"] == pytest.approx(values.mean()) and got["std"] == pytest.approx(values.std(ddof=1))
    assert got["skewness"] == pytest.approx((d ** 3).mean() / (d ** 2).mean() ** 1.5)
    assert got["kurtosis"] == pytest.approx((d ** 4).mean() / (d ** 2).mean() ** 2 - 3)
    assert got["median"] == pytest.approx(np.median(values), abs=0)


def test_constant_column(edge):
    got = {r.column: r for r in profile.numeric_stats(edge).collect()}
    assert got["const"]["std"] == 0 and got["const"]["median"] == 7.0 and got["const"]["skewness"] is None


@pytest.mark.parametrize("linear, doubling", [(1 << 16, 1 << 8), (4, 1)])
def test_percentiles_are_exact(spark, monkeypatch, linear, doubling):
    # a hot value, long tails, far clusters and infinite values, with fine and with coarse bins
    monkeypatch.setattr(percentiles, "LINEAR_BINS", linear)
    monkeypatch.setattr(percentiles, "BINS_PER_DOUBLING", doubling)
    rng = np.random.default_rng(3)
    n = 200_000
    hot = np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 1, n))
    tail = np.exp(rng.normal(0, 8, n))
    frame = pd.DataFrame({
        "hot": hot, "tail": tail, "whole": np.arange(n)[rng.permutation(n)], "far": 1.7e9 + rng.normal(0, 1e-3, n),
        "signs": np.sign(rng.normal(0, 1, n)) * np.exp(rng.normal(-300, 50, n)),
        "endless": np.where(rng.random(n) < 0.001, np.inf, tail)})
    df = spark.createDataFrame(frame).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.p): r.value for r in percentiles.percentiles(df, list(frame.columns), probs).collect()}
    for c in frame.columns:
        for p in probs:
            if (c, p) == ("endless", 1.0):
                assert got[c, p] == np.inf
                continue
            assert got[c, p] == pytest.approx(np.quantile(frame[c], p), rel=1e-12, abs=0), (c, p)


def test_percentiles_of_few_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    got = {r.p: r.value for r in percentiles.percentiles(df, ["v"], [0.25, 0.5, 0.9]).collect()}
    assert got == {0.25: 1.75, 0.5: 2.5, 0.9: pytest.approx(3.7)}


def test_value_distribution(spark):
    skewed = spark.createDataFrame([(c,) for c in "aaaaabc"], "v string")
    uniform = spark.createDataFrame([(c,) for c in "aabbcc"], "v string")
    single = spark.createDataFrame([("a",), ("a",)], "v string")
    assert [profile.text_stats(d).first().value_distribution for d in (skewed, uniform, single)] == \
        ["skewed", "uniform", "skewed"]


def test_top_values_break_ties_by_value_and_keep_long_texts(spark):
    long_text = "long " * 50
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", long_text, long_text, long_text, None]], "v string")
    got = [(r["rank"], r.value, r.rows) for r in profile.top_values(df, top=3).orderBy("rank").collect()]
    assert got == [(1, long_text, 3), (2, "c", 2), (3, "a", 1)]


def test_datetime_days_are_whole_days(spark):
    times = [datetime.datetime(2024, 1, 1, 23, 0), datetime.datetime(2024, 1, 3, 1, 0)]
    got = profile.datetime_stats(spark.createDataFrame([(t,) for t in times], "t timestamp")).first()
    assert got.date_range_days == 1


def test_profile_of_nothing(spark, edge):
    dataset, columns = profile.profile(edge.limit(0))
    assert dataset.first().row_count == 0
    issues = quality.union_issues(quality.quality_issues(columns), quality.empty_issue(columns))
    assert [(r.type, r.severity) for r in issues.collect()] == [("empty_dataset", "error")]
    assert quality.quality_score(columns, issues).first().score == 0


def test_profile_and_describe(edge):
    dataset, columns = profile.profile(edge)
    assert dataset.first().asDict()["column_count"] == 5 and dataset.first().memory_bytes > 0
    assert columns.count() == 5
    got = {r.column: r for r in profile.describe(edge).collect()}
    assert (got["neg_quantity"]["min"], got["neg_quantity"]["p50"], got["neg_quantity"]["max"]) == (-1, 2.5, 4)


def test_outliers(spark, edge):
    values = [10.0] * 30 + [11.0] * 30 + [90.0]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "id int, v double, flat double")
    assert [(r.id, r.column) for r in outliers.outliers(df, id_cols=("id",)).collect()] == [(60, "v")]
    assert [(r.id, r.column) for r in outliers.outliers(df, method="iqr", id_cols=("id",)).collect()] == [(60, "v")]
    with pytest.raises(ValueError):
        outliers.outliers(df, method="other")


def test_issue_thresholds(spark):
    columns = spark.createDataFrame(
        [("a", 100, 50.0, 10.0), ("b", 100, 50.01, 0.0), ("c", 100, 30.0, 10.01)],
        "column string, row_count long, null_percentage double, duplicate_percentage double")
    got = rows(quality.quality_issues(columns).select("column", "type", "severity"))
    assert got == [("a", "high_null_percentage", "warning"), ("b", "high_null_percentage", "error"),
                   ("c", "high_duplicate_percentage", "warning")]
    issues = quality.quality_issues(columns)
    # 20 + 5 + 5 for the findings; a loses 5, b loses 15 (30 strict), c loses 5
    assert quality.quality_score(columns, issues).first().score == 45
    assert quality.quality_score(columns, issues, strict=True).first().score == 20
    score = quality.quality_score(columns, issues)
    assert quality.passes_gate(score).count() == 0
    advice = quality.recommendations(score, issues)
    assert advice.where("column IS NULL").count() == 1 and advice.count() == 4


def test_rules_check_every_row(spark, edge):
    df = spark.createDataFrame([("ok_1", "1", -1), ("bad id", "x", 2), (None, None, None)], "product_id string, n string, total_count int")
    got = rows(quality.apply_rules(df, [
        {"type": "column_pattern", "pattern": "[A-Za-z0-9_]+$", "columns": ["product_id", "absent"], "severity": "error"},
        {"type": "type_consistency", "data_type": "int", "columns": ["n"]}, quality.negative_rule(df)]))
    assert got == [("column_pattern", "product_id", "error", 2, 1), ("non_negative", "total_count", "warning", 2, 1),
                   ("type_consistency", "n", "warning", 2, 1)]
    assert quality.rule_issues(quality.apply_rules(df, [quality.negative_rule(df)])).first().type == "rule_non_negative"
    with pytest.raises(ValueError):
        quality.apply_rules(df, [{"type": "column_pattern", "pattern": "x", "columns": ["absent"]}])


def test_insights(spark):
    random.seed(1)
    data = [(float(i), 2.0 * i + 1, 5.0, "big" if i else "small", str(i), None if i % 3 else "x") for i in range(60)]
    df = spark.createDataFrame(data, "a double, b double, const double, flag string, name string, holes string")
    got = {(r.type, r.column): r for r in insights.insights(df).collect()}
    assert got["high_correlation", "a"].detail == "b" and got["high_correlation", "a"].value == pytest.approx(1.0)
    assert ("high_correlation", "const") not in got
    assert got["high_cardinality", "name"].value == 60
    assert got["imbalanced", "flag"].detail == "big"
    assert got["missing_values", None].severity == "info"
    r = {(x.column_a, x.column_b): x.r for x in insights.correlations(df).collect()}
    assert r["a", "const"] is None


def test_insights_skip_empty_text_columns(edge):
    assert not [r for r in insights.insights(edge).collect() if r.column == "all_null"]


def test_correlation_uses_rows_that_have_both(spark):
    frame = pd.DataFrame({"x": [1.0, 2, 3, 4, None], "y": [2.0, 1, None, 5, 9]})
    df = spark.createDataFrame(frame)
    assert insights.correlations(df).first().r == pytest.approx(frame["x"].corr(frame["y"]))


def test_trend_and_anomalies(spark):
    days = [(datetime.date(2023, 1 + m, 1), 100.0 + 10 * m) for m in range(12)]
    df = spark.createDataFrame(days, "d date, v double")
    got = insights.trend(df, "d", "v").first()
    assert got.slope == pytest.approx(10) and got.r2 == pytest.approx(1) and got.periods == 12
    many = [(datetime.date(2000 + m // 12, 1 + m % 12, 1), 1000.0 if m == 20 else 10.0 + m % 3) for m in range(48)]
    odd = insights.period_anomalies(spark.createDataFrame(many, "d date, v double"), "d", "v")
    assert [r.period.month for r in odd.collect()] == [9] and not math.isnan(odd.first().score)


def test_brackets_hold_few_values(spark, monkeypatch):
    # one outlier puts all other values into one bin of the first histogram, if it starts from the extremes
    monkeypatch.setattr(percentiles, "COUNTED", 2000)
    monkeypatch.setattr(percentiles, "REACH", 0.5)
    seen, inside = [], percentiles._inside
    monkeypatch.setattr(percentiles, "_inside", lambda cells, brackets: seen.append(brackets) or inside(cells, brackets))
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"cluster": np.append(1e6 + rng.random(60_000), 1e300), "even": np.arange(60_001.0),
                          "hot": np.append(np.full(50_000, 3.0), rng.random(10_001))})
    df = spark.createDataFrame(frame).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.column, r.p): r.value for r in percentiles.percentiles(df, list(frame.columns), probs).collect()}
    for c in frame.columns:
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(frame[c], p), rel=1e-12), (c, p)
    assert max(b.rows for b in seen[-1] if not b.settled) <= 2000 and 2 < len(seen) <= 5


def test_bounds_that_fail_are_made_good(spark, monkeypatch):
    """Where the sketch's bounds miss a rank, its zone is searched; the result is exact all the same."""
    monkeypatch.setattr(percentiles, "SKETCH", 8)
    monkeypatch.setattr(percentiles, "REACH", 1e-6)
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"a": rng.normal(size=5000), "b": rng.integers(0, 40, 5000).astype(float), "c": np.full(5000, 2.5)})
    df = spark.createDataFrame(frame).repartition(4)
    probs = [0.0, 0.01, 0.3, 0.31, 0.77, 1.0]
    for counted in (1 << 20, 100):
        monkeypatch.setattr(percentiles, "COUNTED", counted)
        got = {(r.column, r.p): r.value for r in percentiles.percentiles(df, list(frame.columns), probs).collect()}
        for c in frame.columns:
            for p in probs:
                assert got[c, p] == pytest.approx(np.quantile(frame[c], p), rel=1e-12), (c, p)


def test_correlation_of_large_numbers_and_gaps(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(rng.normal(size=(3000, 6)) + 1e9, columns=list("abcdef"))
    frame["b"] = frame["a"] + rng.normal(size=3000) / 10
    frame["f"] = 7.0
    frame = frame.mask(rng.random(frame.shape) < 0.1)
    got = {(r.column_a, r.column_b): r.r for r in insights.correlations(spark.createDataFrame(frame).repartition(5)).collect()}
    want = frame.corr()
    assert len(got) == 15
    for (a, b), r in got.items():
        assert r is None if "f" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-6)
