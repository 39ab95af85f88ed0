"""Operators whose result is a service's answer, as queries: models, streams out, encryption, chunks, query batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import crypto, scalars
from quillon.operators import insights, ml, profile, quality, rows
from quillon.operators.catalog import catalog_of, local_frame, row_counts
from quillon.operators.grain import grains
from quillon.operators.modeling import suggest_fields
from quillon.operators.versioned import KeyedTable
from quillon.operators.visuals import suggest_visuals
from quillon.plans.guard import run_batch
from quillon.plans.report import build_report
from quillon.plans.operator_queries import blanked_orders, event_stream_config, rounded, union_all
from quillon.session import load, load_all, scratch, stored
from quillon.sources.registry import read_source
from quillon.streaming import runner

TREES = 5


def _forest_rows(spark, sf_dir) -> DataFrame:
    """Orders with their price as the target, and features of which some are missing; joined and written once, as training reads
    them many times."""
    price = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return stored(blanked_orders(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("known_price"),
        F.month("o_orderdate").alias("month")).join(price, "o_orderkey"), "forest-rows")


def predict_rows(spark, sf_dir):
    """Every order gets a prediction, whatever its features lack; the forest's error is below a half of that of the mean price."""
    data = _forest_rows(spark, sf_dir)
    model, _ = ml.train(data, "price", key=["o_orderkey"], trees=TREES)
    mean = data.agg(F.avg("price")).scalar()
    scored = ml.predict(model, data)
    return scored.groupBy("o_orderstatus").agg(
        F.count("*").alias("row_count"), F.count("prediction").alias("predicted"), F.count_distinct("o_orderkey").alias("orders"),
        (F.avg(F.pow(F.col("prediction") - F.col("price"), 2)) < 0.5 * F.avg(F.pow(F.col("price") - mean, 2))).alias("beats_mean"))


def classify_rows(spark, sf_dir):
    """Orders by the half of the price range they are in, a class that the features tell for six of seven: nine of ten are right."""
    data = _forest_rows(spark, sf_dir)
    middle = data.agg(((F.min("price") + F.max("price")) / 2)).scalar()
    data = data.withColumn("half", F.when(F.col("price") < middle, "lower").otherwise("upper")).drop("price")
    model, _ = ml.train(data, "half", "classification", key=["o_orderkey"], trees=TREES)
    scored = ml.predict(model, data.drop("half")).select("o_orderkey", "predicted")
    return data.select("o_orderkey", "half").join(scored, "o_orderkey").groupBy("half").agg(
        F.count("*").alias("row_count"), (F.avg((F.col("half") == F.col("predicted")).cast("int")) > 0.85).alias("mostly_right"))


def saved_model_rows(spark, sf_dir):
    """Orders to which a saved and reloaded forest gives another prediction: none."""
    data = _forest_rows(spark, sf_dir)
    model, metrics = ml.train(data, "price", key=["o_orderkey"], trees=TREES)
    path = scratch(spark, "forest")
    ml.save_model(model, path, metrics, [c for c in data.columns if c not in ("price", "o_orderkey")])
    again, info = ml.load_model(spark, path)
    first = ml.predict(model, data).select("o_orderkey", "prediction")
    second = ml.predict(again, data).select("o_orderkey", F.col("prediction").alias("reloaded"))
    features = info.select(F.size(F.from_json("features", "array<string>"))).scalar()
    return first.join(second, "o_orderkey").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("prediction") != F.col("reloaded")).alias("different"),
    ).withColumn("features", features.cast("bigint"))


def stream_profile(spark, sf_dir):
    """Exact column counts of a stream, from the counted values of its batches."""
    raw = runner.read_stream(spark, event_stream_config(spark, sf_dir))
    record = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    sink = scratch(spark, "stream")
    runner.run_counted(runner.good_records(runner.decode(raw, record)), f"{sink}/values", f"{sink}/offsets",
                       available_now=True).awaitTermination()
    return runner.merged_counts(spark, f"{sink}/values")


def stream_publish(spark, sf_dir):
    """Events published as JSON text by a stream and read back."""
    raw = runner.read_stream(spark, event_stream_config(spark, sf_dir))
    events = runner.good_records(runner.decode(raw, "event_id BIGINT, user_id BIGINT, event_type STRING"))
    sink = scratch(spark, "stream")
    runner.publish(events, {"type": "files", "path": f"{sink}/messages"}, f"{sink}/offsets").awaitTermination()
    return spark.read.schema("event_id BIGINT, user_id BIGINT, event_type STRING").json(f"{sink}/messages")


def encrypted_customers(spark, sf_dir):
    """Names after encryption and decryption, and whether the stored text hid them."""
    folder = scratch(spark, "key")
    crypto.store_key(spark, crypto.derive_key("a passphrase", b"sixteen bytes of salt"), folder)
    key = crypto.stored_key(spark, folder)
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("plain"))
    stored = crypto.encrypt_columns(customer, ["c_name"], key)
    opened = crypto.decrypt_columns(stored.withColumn("hidden", ~F.col("c_name").contains(F.col("plain"))), ["c_name"], key)
    return opened.select("c_custkey", "c_name", "hidden")


def chunk_function(spark, sf_dir):
    """A pandas function over slices of all line items; the slices' rows are united."""
    def work(pdf):
        return pdf.assign(l_quantity=pdf["l_quantity"] * 2)

    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    doubled = rows.map_chunks(lines, work, "l_returnflag string, l_quantity double", chunk_size=500)
    return doubled.groupBy("l_returnflag").agg(F.count("*").alias("row_count"), F.sum("l_quantity").alias("quantity"))


def period_anomalies(spark, sf_dir):
    """Months whose order total is more than one and a half deviations from the mean."""
    orders = load(spark, sf_dir, "orders").withColumn("amount", scalars.money(F.col("o_totalprice")))
    found = insights.period_anomalies(orders, "o_orderdate", "amount", threshold=1.5)
    return rounded(found.withColumn("period", F.date_format("period", "yyyy-MM")), 4, "value", "score")


BATCH = (
    ("counts", "orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    ("drop", "orders", "DROP TABLE orders"),
    ("unknown", "orders", "SELECT nothing FROM orders"),
    ("nowhere", "missing", "SELECT 1 AS one"),
    ("parts", "part", "SELECT p_partkey FROM part WHERE p_size > 10"),
)


def query_batch(spark, sf_dir):
    """The status of every query of a batch with the rows of those that ran."""
    tables = load_all(spark, sf_dir, ("orders", "part"))
    status, results = run_batch(spark, [{"id": i, "data_source": s, "query": q} for i, s, q in BATCH],
                                {t: {t: df} for t, df in tables.items()})
    said = local_frame(spark, [(s["id"], s["status"], ",".join(s["columns"])) for s in status],
                       "id string, status string, columns string")
    counted = union_all([df.agg(F.count("*").alias("row_count")).withColumn("id", F.lit(i)) for i, df in results.items()])
    return said.join(counted, "id", "left")


def quality_gate(spark, sf_dir):
    """The advice on three tables, one of them without rows, and whether their scores pass the gate."""
    out = []
    orders = blanked_orders(spark, sf_dir)
    for name, df in (("orders", orders), ("part", load(spark, sf_dir, "part")), ("none", orders.where("o_orderkey < 0"))):
        # a row per column, which the issues, the score, the gate and the advice all read
        counts = stored(profile.column_counts(df, approx=name == "none"), "counts")
        issues = quality.union_issues(quality.quality_issues(counts), quality.empty_issue(counts))
        score = quality.quality_score(counts, issues)
        passed = quality.passes_gate(score).agg((F.count("*") > 0).alias("p")).scalar()
        advice = quality.recommendations(score, issues)
        out.append(advice.groupBy("advice").agg(F.count("*").alias("findings")).select(
            F.lit(name).alias("table"), "advice", "findings", passed.alias("passed")))
    return union_all(out)


def visual_suggestions(spark, sf_dir):
    """The visuals that the fields of every table allow, with the rows they would show."""
    tables = load_all(spark, sf_dir)
    fields = suggest_fields(catalog_of(spark, tables))
    return suggest_visuals(fields).join(row_counts(tables), "table").withColumn(
        "priority", F.col("priority").cast("bigint"))


PAGES_A_FILE = 2000


def json_documents(spark, sf_dir):
    """Pages written as one JSON list per file over several lines, and read back."""
    path = scratch(spark, "documents")
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    parts = pages.agg(F.greatest(F.ceil(F.count("*") / PAGES_A_FILE), F.lit(16))).scalar()
    listed = pages.groupBy(F.pmod(F.xxhash64("page_id"), parts).alias("part")).agg(
        F.sort_array(F.collect_list(F.to_json(F.struct("page_id", "url")))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join("rows", ",\n  "), F.lit("]"))
    listed.repartition("part").select(text.alias("value"), "part").write.partitionBy("part").text(f"{path}/pages")
    return read_source(spark, {"type": "json", "path": path, "multi_line": True,
                               "schema": "page_id bigint, url string"}, "pages").select("page_id", "url")


def versioned_upsert(spark, sf_dir):
    """Customers in a keyed table after updates of every tenth and some new ones, and which version first had the row."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    table = KeyedTable(spark, scratch(spark, "keyed"))
    first = table.create(customer, ["c_custkey"], buckets=16)
    changed = customer.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lower("c_mktsegment"))
    second = table.upsert(changed.unionByName(customer.where("c_custkey % 50 = 1").withColumn("c_custkey", -F.col("c_custkey"))))
    third = table.delete(customer.where("c_custkey % 100 = 3"))
    touched = union_all([table.changes(a, b).select("c_custkey", F.lit(b).alias("version")) for a, b in ((first, second), (second, third))])
    return table.read().join(touched, "c_custkey", "left").select(
        "c_custkey", "c_name", "c_mktsegment", F.coalesce("version", F.lit(first)).cast("bigint").alias("version"))


def table_grains(spark, sf_dir):
    """The minimal keys of up to three columns of every table, beside its rows."""
    tables = load_all(spark, sf_dir)
    return grains(tables).withColumn("size", F.col("size").cast("bigint")).join(row_counts(tables), "table")


def chunk_errors(spark, sf_dir):
    """A pandas function that refuses slices of many returned items: rows made and rows set aside, together all rows."""
    def work(pdf):
        if (pdf["l_returnflag"] == "R").mean() > 0.25:
            raise ValueError("too many returns")
        return pdf[["l_orderkey", "l_returnflag"]]

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    made, failed = rows.map_chunks_apart(lines, work, "l_orderkey bigint, l_returnflag string", chunk_size=100)
    apart = failed.select(F.explode("records").alias("r")).select(
        F.get_json_object("r", "$.l_orderkey").cast("bigint").alias("l_orderkey"), F.get_json_object("r", "$.l_returnflag").alias("l_returnflag"))
    refused = failed.agg((F.coalesce(F.sum("rows"), F.lit(0)) == apart.agg(F.count("*")).scalar()).alias("c")).scalar()
    return made.unionByName(apart).groupBy("l_returnflag").agg(
        F.count("*").alias("row_count"), F.sum("l_orderkey").alias("keys")).withColumn("counted", refused)


def report_columns(spark, sf_dir):
    """The report on orders and customers: the profile of every column of their join, and the shape of the data set."""
    tables = load_all(spark, sf_dir, ("orders", "customer", "part", "region"))
    tables["orders"] = tables["orders"].withColumnRenamed("o_custkey", "custkey")
    tables["customer"] = tables["customer"].withColumnRenamed("c_custkey", "custkey")
    report = build_report(spark, tables, "orders by customer", tables=2)
    shape = report["dataset"].select(F.struct("row_count", "column_count").alias("s")).scalar()
    return report["columns"].select("column", "row_count", "null_count", "unique_count", shape["column_count"].alias("column_count"),
                                    (shape["row_count"] == F.col("row_count")).alias("whole"))


SERVICE_QUERIES = {f.__name__: f for f in (
    predict_rows, classify_rows, saved_model_rows, stream_profile, stream_publish, encrypted_customers, chunk_function,
    period_anomalies, query_batch, quality_gate, visual_suggestions, json_documents, versioned_upsert, table_grains,
    chunk_errors, report_columns)}
