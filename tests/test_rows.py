import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import ml, rows as R
from tests.conftest import rows


def test_row_numbers_over_a_hot_value(spark):
    n = 3000
    # a third of the rows share one value
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("v")).repartition(6)
    got = R.with_row_number(df, "v", "rn").toPandas().sort_values("rn")
    assert list(got["rn"]) == list(range(1, n + 1))
    assert got["v"].is_monotonic_increasing and got["id"].nunique() == n


def test_chunk_summary_matches_pandas(spark):
    frame = pd.DataFrame({"k": range(0, 2300), "v": [float((i * 37) % 101) for i in range(2300)]})
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r.chunk, r.column): r for r in R.chunk_summary(df, "k", 1000, ["v"]).collect()}
    assert sorted(c for c, _ in got) == [0, 1, 2]
    for chunk, part in frame.groupby(frame.index // 1000):
        r = got[chunk, "v"]
        assert (r["count"], r["min"], r["max"]) == (len(part), part.v.min(), part.v.max())
        assert r["mean"] == pytest.approx(part.v.mean()) and r["median"] == part.v.median()


def test_sample_and_retention(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    assert rows(R.sample(df, 3, ["id"]).select("id")) == [(0,), (1,), (2,)]
    kept = R.retain_last(df, ["g"], [F.desc("id")], 2)
    assert rows(kept.select("g", "id")) == [(0, 96), (0, 98), (1, 97), (1, 99)]


def test_retention_limits_before_the_shuffle(spark):
    plan = R.retain_last(spark.range(10).withColumn("g", F.col("id") % 2), ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_upsert_takes_the_last_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, at int")
    assert rows(R.upsert(target, updates, ["k"], "at")) == [(1, "a"), (2, "y"), (3, None)]


def test_chunk_function_errors(spark):
    df = spark.range(0, 40, numPartitions=2)

    def work(pdf):
        if (pdf["id"] == 25).any():
            raise ValueError("bad chunk")
        return pdf.assign(size=len(pdf))

    errors = spark.sparkContext.accumulator(0)
    got = R.map_chunks(df, work, "id long, size long", chunk_size=10, on_error="skip", errors=errors)
    assert sorted(r.id for r in got.collect()) == [i for i in range(40) if not 20 <= i < 30]
    assert errors.value == 1
    with pytest.raises(Exception, match="bad chunk"):
        R.map_chunks(df, work, "id long, size long", 10).collect()
    with pytest.raises(ValueError):
        R.map_chunks(df, work, "id long", on_error="ignore")


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    assert rows(ml.label_encode(df, "v", "code")) == [(None, None), ("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_split_is_stable(spark):
    df = spark.range(5000)
    fit, test = ml.train_test_split(df, ["id"])
    again, _ = ml.train_test_split(df.repartition(7), ["id"])
    assert fit.count() + test.count() == 5000 and abs(fit.count() - 4000) < 150
    assert fit.exceptAll(again).count() == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 3.0), (None, 1.0)], "y double, p double")
    got = ml.regression_metrics(df, "y", "p").first()
    assert (got.n, got.mse) == (3, pytest.approx(4 / 3)) and got.r2 == pytest.approx(1 - 4 / 2)


def test_regression_forest(spark, tmp_path):
    df = spark.range(600).select("id", (F.col("id") % 50).cast("double").alias("x1"),
                                 F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("cat"))
    df = df.withColumn("y", F.col("x1") * 3 + F.when(F.col("cat") == "even", 100).otherwise(0))
    model, metrics = ml.train(df, "y", "regression", ["id"], trees=15)
    first = metrics.first()
    assert first.r2 > 0.9
    ml.save_model(model, str(tmp_path / "m"), metrics, ["x1", "cat"])
    loaded, info = ml.load_model(spark, str(tmp_path / "m"))
    # a value that training never saw still gets a prediction
    new = spark.createDataFrame([(1, 10.0, "even"), (2, 10.0, "unseen")], "id int, x1 double, cat string")
    got = ml.predict(loaded, new)
    assert got.columns == ["id", "x1", "cat", "prediction"] and got.count() == 2
    assert abs(got.where("id = 1").first().prediction - 130) < 30
    assert "r2" in info.first().metrics


def test_classification_forest(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"))
    df = df.withColumn("kind", F.when(F.col("x") < 10, "low").otherwise("high"))
    model, metrics = ml.train(df, "kind", "classification", ["id"], trees=10)
    assert metrics.first().accuracy > 0.95
    got = ml.predict(model, df.select("id", "x").limit(5))
    assert {"predicted", "probability"} <= set(got.columns) and got.where("predicted IN ('low', 'high')").count() == 5
    with pytest.raises(ValueError):
        ml.train(df, "kind", "clustering", ["id"])
