"""Results that must be whole: no row, field or value goes missing on the way."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import crypto
from quillon.operators import drift, insights, ml, profile
from quillon.operators import rows as R
from quillon.operators.measures import Measure, measures
from quillon.operators.visuals import table_visual, visual
from quillon.plans.guard import check_sql, guarded_sql
from quillon.sources import registry
from quillon.sources.registry import kafka_options
from tests.test_sources import write_pages


def api(tmp_path, **more):
    return {"type": "api", "endpoint": str(tmp_path), "fetcher": "tests.pages:fetch_page", "paginate": "true",
            "parallelism": 2, **more}


def test_streams_have_no_cap_of_their_own():
    cfg = {"bootstrap_servers": "x", "topic": "t"}
    assert "maxOffsetsPerTrigger" not in kafka_options(cfg, None)
    assert kafka_options({**cfg, "batch_size": 7}, None)["maxOffsetsPerTrigger"] == "7"


def test_rest_late_field_and_misfit_are_errors(spark, tmp_path):
    write_pages(tmp_path, [[{"id": i} for i in range(20)], [{"id": 20, "late": "x"}], []])
    with pytest.raises(Exception, match="late"):
        registry.read_source(spark, api(tmp_path)).collect()
    got = registry.read_source(spark, api(tmp_path, schema="id bigint, late string"))
    assert got.count() == 21 and got.where("late = 'x'").count() == 1
    write_pages(tmp_path, [[{"id": 1}], [{"id": 11.7}], []])
    with pytest.raises(Exception, match="11.7"):
        registry.read_source(spark, api(tmp_path)).collect()


def test_rest_error_page_and_total_limit(spark, tmp_path):
    write_pages(tmp_path, [[{"id": 1}], [{"id": 2}], {"error": "quota"}, [{"id": 4}], []])
    with pytest.raises(Exception, match="quota"):
        registry.read_source(spark, api(tmp_path)).collect()
    write_pages(tmp_path, [[{"id": 10 * p + i} for i in range(4)] for p in range(8)] + [[]])
    assert registry.read_source(spark, api(tmp_path, limit=7, parallelism=4)).count() == 7


def test_database_schema_is_no_read_schema(spark):
    with pytest.raises(Exception) as error:
        registry.read_source(spark, {"type": "snowflake", "account": "a", "database": "d", "user": "u", "password": "p",
                                     "schema": "SALES"}, "T")
    assert "ParseException" not in type(error.value).__name__


def test_top_values_of_long_texts_are_values_in_order(spark):
    stem = "x" * 80
    texts = [stem + c for c in "fedcba"] * 2 + ["short"] + [stem + "z"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.value for r in profile.top_values(df, ["t"], 4).orderBy("rank").collect()]
    assert got == [stem + "z", stem + "a", stem + "b", stem + "c"]


def test_imbalance_names_the_value(spark):
    long = "a very long value " * 10
    df = spark.createDataFrame([(long,)] * 9 + [("b",)], "t string")
    assert insights.imbalance(df).first().value == long


def test_every_row_is_predicted(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"),
                                 F.when(F.col("id") % 5 > 0, F.lit("a")).alias("c"), (F.col("id") * 2.0).alias("y"))
    model, _ = ml.train(df, "y", key=["id"], trees=3)
    scored = ml.predict(model, df)
    assert scored.count() == 200 and scored.where("prediction IS NULL").count() == 0
    assert not [c for c in scored.columns if c.endswith("__number")]


def test_drift_of_any_age(spark, tmp_path):
    schema = "`table` string, `column` string, type string, nullable boolean"
    old = spark.createDataFrame([("t", "c", "int", True)], schema)
    (old.withColumns({"source": F.lit("s"), "taken_at": F.expr("current_timestamp() - interval 3 days")})
     .write.partitionBy("source").parquet(str(tmp_path / "snap")))
    new = spark.createDataFrame([("t", "c", "string", True)], schema)
    known, changes = drift.detect_drift(spark, str(tmp_path / "snap"), "s", new)
    assert known and [r.type for r in changes.collect()] == ["column_type_changed"]


def test_a_failing_chunk_fails_the_job(spark):
    def broken(pdf):
        raise ValueError("no")
    with pytest.raises(Exception, match="no"):
        R.map_chunks(spark.range(5), broken, "id long").collect()


def test_retain_more_than_a_thousand(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    got = R.retain_last(df, ["k"], [F.desc("id")], 1500)
    assert sorted(r.id for r in got.collect()) == list(range(3000, 6000))


def test_names_with_spaces_and_all_measures(spark):
    df = spark.createDataFrame([(1.0, "a", 2)], "`unit price` double, g string, `b c` int")
    assert measures(df, [Measure("unit price", "SUM", "total")]).first().total == 1.0
    wide = spark.range(2).select(*[F.col("id").alias(f"c{i}") for i in range(12)])
    assert len(table_visual(wide, [], wide.columns, None).columns) == 12
    specs = [Measure(f"c{i}") for i in range(6)]
    assert len(visual(wide, "card", [], specs, limits=None).columns) == 6
    assert len(visual(wide, "card", [], specs).columns) == 4


def test_guard_reads_registered_frames_only(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "secret"))
    with pytest.raises(Exception):
        guarded_sql(spark, f"SELECT * FROM parquet.`{tmp_path}/secret`")
    for call in ("reflect('java.lang.System', 'getenv')", "`reflect`('java.lang.System', 'getenv')", "java_method('a', 'b')"):
        with pytest.raises(ValueError):
            check_sql(f"SELECT {call}")
    first = guarded_sql(spark, "SELECT count(*) AS n FROM t", {"t": spark.range(3)})
    second = guarded_sql(spark, "SELECT count(*) AS n FROM t", {"t": spark.range(5)})
    assert (first.first().n, second.first().n) == (3, 5) and not spark.catalog.tableExists("t")


def test_guard_hides_the_views_of_the_session(spark):
    spark.range(7).createOrReplaceTempView("private")
    spark.range(9).createOrReplaceGlobalTempView("private_global")
    views = {"t": spark.range(3)}
    try:
        for sql in ("SELECT * FROM private", "SELECT * FROM t WHERE id IN (SELECT id FROM private)", "SELECT (SELECT max(id) FROM Private) AS m FROM t",
                    "SELECT * FROM global_temp.private_global", "WITH a AS (SELECT * FROM private) SELECT * FROM a",
                    "SELECT * FROM t JOIN private p ON t.id = p.id"):
            with pytest.raises(ValueError, match="not a registered frame"):
                guarded_sql(spark, sql, views)
        # a name that the query gives itself is its own, not the session's
        with pytest.raises(Exception):
            guarded_sql(spark, "SELECT * FROM private JOIN (WITH private AS (SELECT 1 AS id) SELECT * FROM private) USING (id)", views).collect()
        assert guarded_sql(spark, "WITH a AS (SELECT id FROM t) SELECT count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM t)", views).first().n == 3
        assert guarded_sql(spark, "SELECT count(*) AS n FROM private", {"private": spark.range(2)}).first().n == 2
        assert spark.table("private").count() == 7
    finally:
        spark.catalog.dropTempView("private")
        spark.catalog.dropGlobalTempView("private_global")


def test_failing_slices_are_rows(spark):
    def work(pdf):
        if (pdf["id"] % 50 == 25).any():
            raise ValueError(f"bad {len(pdf)}")
        return pdf.assign(twice=pdf["id"] * 2)

    df = spark.range(0, 200, numPartitions=4)
    made, failed = R.map_chunks_apart(df, work, "id long, twice long", chunk_size=10)
    apart = failed.collect()
    assert made.count() + sum(f.rows for f in apart) == 200 and {f.message for f in apart} == {"ValueError: bad 10"}
    assert len({(f.partition, f.slice) for f in apart}) == len(apart) == 4
    lost = {json.loads(r)["id"] for f in apart for r in f.records}
    assert lost | {r.id for r in made.collect()} == set(range(200)) and len(lost) == 40
    assert made.where("twice = 2 * id").count() == 160


def test_codes_beyond_any_limit(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).cast("double").alias("x"),
                                  F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("kind"))
    model, metrics = ml.train(df, "kind", "classification", key=["id"], trees=5)
    assert metrics.first().accuracy > 0.9
    ml.save_model(model, str(tmp_path / "m"), metrics, ["name", "x"])
    again, _ = ml.load_model(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "v5", 5.0), (2, "never seen", 2.0), (3, None, 3.0)], "id long, name string, x double")
    got = {r.id: r.predicted for r in ml.predict(again, new).collect()}
    assert got == {1: "c5", 2: "c2", 3: "c3"}
    stages = [s for s in again.stages if isinstance(s, ml.CodeTable)]
    assert all(s.getOrDefault("path").startswith(str(tmp_path)) for s in stages) and len(stages) == 3
    assert stages[0].codes(spark).count() == 3000


def test_a_stored_key_is_in_no_plan(spark, tmp_path):
    key = crypto.derive_key("a passphrase", b"sixteen bytes of salt")
    crypto.store_key(spark, key, str(tmp_path / "key"))
    df = spark.createDataFrame([("a",), (None,)], "s string")
    column = crypto.stored_key(spark, str(tmp_path / "key"))
    locked = crypto.encrypt_columns(df, ["s"], column)
    locked.collect()
    plan = locked._jdf.queryExecution().toString()
    assert key.hex() not in plan.lower() and base64.b64encode(key).decode() not in plan and "key" in plan
    assert crypto.decrypt_columns(locked, ["s"], key).orderBy("s").collect() == df.orderBy("s").collect()


def test_json_documents_are_rows_or_an_error(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('[\n  {"id": 1},\n  {"id": 2}\n]\n')
    cfg = {"type": "s3", "path": str(tmp_path), "schema": "id bigint"}
    with pytest.raises(Exception):
        registry.read_source(spark, cfg, "a").collect()
    assert sorted(r.id for r in registry.read_source(spark, {**cfg, "multi_line": True}, "a").collect()) == [1, 2]
