"""Every operator as a query over the whole test tables: ``name(spark, sf_dir) -> DataFrame``.

The tables hold no missing values, so the quality queries blank some of them by rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import dates, formats, nested, scalars
from quillon.functions.types import cast_plan, failed_casts
from quillon.operators import (
    catalog, drift, insights, ml, modeling, outliers, profile, quality, rows,
)
from quillon.operators.measures import Measure, measure_rows, measures, time_intelligence
from quillon.operators.natural_join import natural_join
from quillon.operators.visuals import apply_filters, table_visual, visual_bundle
from quillon.plans.guard import guarded_sql
from quillon.plans.workload import orders_with_revenue
from quillon.session import load, load_all, scratch, stored
from quillon.sources.files import union_frames
from quillon.sources.registry import apply_cuts, read_source
from quillon.streaming import runner


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def blanked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every seventh price and every second priority blank."""
    return load(spark, sf_dir, "orders").withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority"))})


# --- sources, projections, filters -------------------------------------------------------

def scan_csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "csv")
    orders = load(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    orders.write.csv(path, header=True)
    schema = orders.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return read_source(spark, {"type": "csv", "path": path, "schema": schema})


def scan_json_multi(spark, sf_dir):
    """Customers as JSON and suppliers as CSV below one prefix, read back as one table."""
    path = scratch(spark, "objects")
    customer = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    supplier = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer.write.json(f"{path}/parties/customers")
    supplier.write.csv(f"{path}/parties/suppliers", header=True)
    cfg = {"type": "s3", "path": path, "schema": "party_key bigint, name string, balance double"}
    return read_source(spark, cfg, "parties")


def union_files(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    supplier = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_frames([customer, supplier])


def flatten_json_props(spark, sf_dir):
    events = nested.parse_json(load(spark, sf_dir, "events"), "props", "k BIGINT", into="details")
    return nested.flatten_structs(events.select(
        "event_id", F.struct("user_id", F.struct("event_type", "value").alias("event")).alias("source"), "details"))


def project_filter_limit(spark, sf_dir):
    df = read_source(spark, {"type": "parquet", "path": sf_dir, "extension": ".parquet"}, "lineitem",
                     ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"],
                     "l_quantity >= 45 AND l_returnflag = 'R'")
    return apply_cuts(df.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber"), limit=100)


def sample_rows(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rows.sample(orders, 1000, ["o_orderkey"])


def cast_plan_events(spark, sf_dir):
    """Values lost per column when text is cast to the types of a catalog."""
    mixed = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    events = load(spark, sf_dir, "events").select("event_id", "value", "event_type", "props", mixed.alias("user_ref"))
    return failed_casts(events, {"event_id": "decimal(20,2)", "value": "bigint", "event_type": "date",
                                 "props": "int", "user_ref": "bigint"})


def cast_rows_events(spark, sf_dir):
    mixed = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    events = load(spark, sf_dir, "events").select("event_id", mixed.alias("user_ref"), "event_type")
    return cast_plan(events, {"user_ref": "bigint", "event_type": "varchar"})


def filter_last_12_months(spark, sf_dir):
    kept = apply_filters(load(spark, sf_dir, "orders"), [
        {"type": "date_range", "field": "o_orderdate", "range": "last_12_months"},
        {"type": "dropdown", "field": "o_orderpriority", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}])
    return kept.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority", "o_totalprice")


def visual_table(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return table_visual(line, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                        [c for c in line.columns if c not in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


def chunk_summary(spark, sf_dir):
    found = rows.chunk_summary(load(spark, sf_dir, "orders"), "o_orderkey", 5000, ["o_totalprice", "o_custkey"])
    return rounded(found, 4, "mean", "std", "median")


# --- joins, keys, relationships ----------------------------------------------------------

def natural_join_fold(spark, sf_dir):
    """Orders, customers and nations on the names they share; some keys are missing on both sides."""
    orders = load(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 100 != 0, F.col("o_custkey")).alias("custkey"), "o_totalprice")
    customer = load(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    joined, skipped = natural_join({"orders": orders, "customer": customer, "nation": nation,
                                    "events": load(spark, sf_dir, "events").select("event_id")})
    return joined.groupBy("n_name").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("custkey").isNull()).alias("blank_keys"),
        F.sum(scalars.money(F.col("o_totalprice"))).cast("double").alias("total"),
    ).withColumn("skipped_tables", F.lit(",".join(skipped)))


def model_parts(spark, sf_dir):
    """All tables, their catalog, named keys, what the data says about them, and the counted keys."""
    tables = load_all(spark, sf_dir)
    cat = catalog.catalog_of(spark, tables)
    keys = modeling.detect_keys(cat)
    columns: dict[str, list[str]] = {}
    # names only: one row per key column of the catalog
    for r in keys.select("table", "column").distinct().collect():
        columns.setdefault(r.table, []).append(r.column)
    counted = modeling.counted_keys(tables, columns)
    return tables, cat, keys, modeling.key_profile(tables, columns, counted), counted


def model_edges(spark, sf_dir, parts=None):
    """Tables, edges by name between proven keys, and the counted keys."""
    tables, cat, keys, proven, counted = parts or model_parts(spark, sf_dir)
    kinds = modeling.classify_tables(cat, keys)
    edges = modeling.infer_relationships(cat, kinds, star_only=False, strip_prefix=True,
                                         own_keys=proven.where("is_unique"))
    return tables, modeling.edge_list(edges.orderBy(*modeling.EDGE_FIELDS)), counted


def detect_key_columns(spark, sf_dir):
    """Key columns by name with what the data says about them."""
    _, _, keys, proven, _ = model_parts(spark, sf_dir)
    return keys.select("table", "column", "category").join(proven, ["table", "column"])


def classify_tables(spark, sf_dir):
    _, cat, keys, proven, _ = model_parts(spark, sf_dir)
    return modeling.classify_tables(cat, keys, proven.where("is_unique"))


def suggest_measures_dims(spark, sf_dir):
    """Suggested fields with their filled rows."""
    tables = load_all(spark, sf_dir)
    fields = modeling.suggest_fields(catalog.catalog_of(spark, tables))
    return fields.join(catalog.column_fill(tables), ["table", "column"]).select(
        "table", "column", "role", "suggestion", "row_count", "value_count")


def infer_relationships(spark, sf_dir):
    """Edges by name with the rows that have, or lack, a partner."""
    return modeling.inclusion(*model_edges(spark, sf_dir))


def relationship_cardinality(spark, sf_dir):
    return modeling.cardinality(*model_edges(spark, sf_dir))


def both_ways(edges: list[dict]) -> list[dict]:
    back = [{"from_table": e["to_table"], "from_column": e["to_column"],
             "to_table": e["from_table"], "to_column": e["from_column"]} for e in edges]
    return edges + [e for e in back if e not in edges]


def relationship_cycles(spark, sf_dir):
    """Cycles among the edges, either way round, along which every key has a partner."""
    tables, edges, counted = model_edges(spark, sf_dir)
    held = modeling.inclusion(tables, both_ways(edges), counted).where("orphan_rows = 0")
    return modeling.relationship_cycles(held)


def model_score(spark, sf_dir):
    tables, cat, keys, proven, counted = parts = model_parts(spark, sf_dir)
    _, edges, _ = model_edges(spark, sf_dir, parts)
    measured = modeling.cardinality(tables, edges, counted)
    has_key = cat.select("table").distinct().join(
        proven.groupBy("table").agg(F.bool_or("is_unique").alias("has_key")), "table", "left").select(
        "table", F.coalesce("has_key", F.lit(False)).alias("has_key"))
    held = modeling.inclusion(tables, both_ways(edges), counted).where("orphan_rows = 0")
    star = modeling.star_compliance(cat, keys, measured)
    return modeling.validate_model(has_key, measured, modeling.relationship_cycles(held), star)


def verify_primary_key(spark, sf_dir):
    return union_all([
        modeling.verify_primary_key(load(spark, sf_dir, "orders"), ["o_orderkey"]),
        modeling.verify_primary_key(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])])


def fk_orphans(spark, sf_dir):
    """Documents without a label."""
    return modeling.fk_orphans(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")


def upsert_customers(spark, sf_dir):
    """Customers with the balance of their last urgent order, and suppliers as new customers."""
    customer = load(spark, sf_dir, "customer")
    changed = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"), F.lit("changed").alias("c_name"), F.lit(0).alias("c_nationkey"),
        F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_orderkey").alias("version"))
    added = load(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"), F.lit(0).cast("bigint").alias("version"))
    return rows.upsert(customer, changed.unionByName(added), ["c_custkey"], "version")


# --- catalog and drift -------------------------------------------------------------------

def catalog_columns(spark, sf_dir):
    return catalog.catalog_with_counts(spark, load_all(spark, sf_dir)).select(
        "table", "column", "type", F.col("position").cast("bigint").alias("position"), "row_count", "value_count")


def catalog_row_counts(spark, sf_dir):
    return catalog.row_counts(load_all(spark, sf_dir))


def catalog_summary(spark, sf_dir):
    """The four widest tables with their first five columns and filled rows."""
    tables = load_all(spark, sf_dir)
    short = catalog.summarize_catalog(catalog.catalog_of(spark, tables), max_tables=4, max_cols=5)
    wanted = {r.table for r in short.select("table").distinct().collect()}  # at most four names
    fill = catalog.column_fill({t: tables[t] for t in sorted(wanted)})
    return short.join(fill, ["table", "column"]).select(
        "table", "column", F.col("position").cast("bigint").alias("position"),
        F.col("table_rank").cast("bigint").alias("table_rank"), "column_count", "row_count", "value_count")


def drifted_tables(spark, sf_dir):
    """Two states of a source: one table comes, one goes, columns come, go and change type."""
    t = load_all(spark, sf_dir, ("customer", "orders", "part", "supplier"))
    old = {"customer": t["customer"], "orders": t["orders"], "part": t["part"]}
    new = {
        "customer": t["customer"].withColumn("c_country", F.lit("")),
        "orders": t["orders"].drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")),
        "supplier": t["supplier"],
    }
    return old, new


def schema_drift_diff(spark, sf_dir):
    """Changes between the two states, with the rows of the table before and after."""
    old, new = drifted_tables(spark, sf_dir)
    changes = drift.schema_diff(catalog.catalog_of(spark, old), catalog.catalog_of(spark, new))
    before = catalog.row_counts(old).withColumnRenamed("row_count", "old_rows")
    after = catalog.row_counts(new).withColumnRenamed("row_count", "new_rows")
    return changes.join(before, "table", "left").join(after, "table", "left")


def catalog_set_ops(spark, sf_dir):
    old, new = drifted_tables(spark, sf_dir)
    return drift.catalog_sets(catalog.column_fill(old).select("table", "column", "value_count"),
                              catalog.column_fill(new).select("table", "column", "value_count"))


def table_relevance(spark, sf_dir):
    """The five tables that fit the text of every document best."""
    cat = catalog.catalog_of(spark, load_all(spark, sf_dir))
    ranked = catalog.rank_tables(cat, load(spark, sf_dir, "documents"), "doc_id", "text")
    return ranked.select("doc_id", "table", F.col("score").cast("bigint").alias("score"),
                         F.col("rank").cast("bigint").alias("rank"))


def model_complexity(spark, sf_dir):
    return catalog.model_size(load_all(spark, sf_dir), n_measures=6)


# --- profile -----------------------------------------------------------------------------

def profile_dataset(spark, sf_dir):
    return union_all([profile.dataset_row(load(spark, sf_dir, t)).withColumn("table", F.lit(t))
                      for t in ("orders", "lineitem", "documents", "events")])


def profile_nulls(spark, sf_dir):
    return profile.column_counts(blanked_orders(spark, sf_dir)).select(
        "column", "row_count", "null_count", "null_percentage")


def profile_distinct(spark, sf_dir):
    frames = [profile.column_counts(df).select("column", "unique_count", "duplicate_count", "duplicate_percentage")
              for df in (blanked_orders(spark, sf_dir), load(spark, sf_dir, "documents"))]
    return union_all(frames)


def profile_numeric(spark, sf_dir):
    return rounded(profile.numeric_stats(blanked_orders(spark, sf_dir)).drop("skewness", "kurtosis"),
                   4, "mean", "std", "median")


def profile_moments(spark, sf_dir):
    frames = [profile.numeric_stats(df, cols, median=False).select("column", "skewness", "kurtosis")
              for df, cols in ((load(spark, sf_dir, "events"), ["value"]),
                               (load(spark, sf_dir, "documents"), ["n_chars"]),
                               (load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))]
    return rounded(union_all(frames), 6, "skewness", "kurtosis")


def profile_top_values(spark, sf_dir):
    frames = [profile.top_values(df, cols).withColumn("table", F.lit(t)) for t, df, cols in (
        ("orders", load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]),
        ("documents", load(spark, sf_dir, "documents"), ["lang", "source", "text"]))]
    return union_all(frames).withColumn("rank", F.col("rank").cast("bigint"))


def profile_text(spark, sf_dir):
    frames = [profile.text_stats(load(spark, sf_dir, t)) for t in ("customer", "part", "documents")]
    lengths = {c: F.col(c).cast("bigint") for c in ("max_length", "min_length")}
    return rounded(union_all(frames).withColumns(lengths), 6, "avg_length")


def profile_datetime(spark, sf_dir):
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    frames = [profile.datetime_stats(load(spark, sf_dir, t)) for t in ("orders", "lineitem", "events")]
    return union_all(frames).withColumns({c: F.date_format(c, stamp) for c in ("min_date", "max_date")})


def describe_numeric(spark, sf_dir):
    found = profile.describe(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(found, 4, "mean", "std", "p25", "p50", "p75")


def outliers_zscore(spark, sf_dir):
    found = outliers.outliers(load(spark, sf_dir, "events"), ["value"], "zscore", id_cols=("event_id",))
    return rounded(found, 6, "score")


def outliers_iqr(spark, sf_dir):
    found = outliers.outliers(load(spark, sf_dir, "documents"), ["n_chars"], "iqr", id_cols=("doc_id",))
    return rounded(found, 4, "lower_bound", "upper_bound")


# --- quality -----------------------------------------------------------------------------

def quality_issues(spark, sf_dir):
    return quality.quality_issues(profile.column_counts(blanked_orders(spark, sf_dir)))


def quality_score(spark, sf_dir):
    """Scores of the blanked orders and of the raw part table, default and strict weights."""
    frames = []
    for name, df in (("orders", blanked_orders(spark, sf_dir)), ("part", load(spark, sf_dir, "part"))):
        counts = stored(profile.column_counts(df), "counts")  # a row per column
        found = quality.quality_issues(counts)
        for strict in (False, True):
            frames.append(quality.quality_score(counts, found, strict).select(
                F.lit(name).alias("table"), F.lit(strict).alias("strict"), "issue_count", "error_count", "score"))
    return union_all(frames)


def rule_type_consistency(spark, sf_dir):
    mixed = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    events = load(spark, sf_dir, "events").withColumn("user_ref", mixed)
    return quality.apply_rules(events, [
        {"type": "type_consistency", "data_type": "bigint", "columns": ["user_ref", "event_id", "not_there"]}])


def rule_negative_values(spark, sf_dir):
    """Numeric columns named like counts or ids; one of them is shifted below zero."""
    line = load(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") - 5).alias("l_quantity"), F.col("l_orderkey").alias("order_id"), "l_discount")
    return quality.apply_rules(line, [quality.negative_rule(line)])


def rule_column_pattern(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return quality.apply_rules(part, [
        {"type": "column_pattern", "pattern": "[A-Za-z0-9_]+$", "columns": ["p_name", "p_brand", "p_type"]},
        {"type": "column_pattern", "pattern": "Brand#[12]", "columns": ["p_brand"], "severity": "error"}])


# --- insights ----------------------------------------------------------------------------

def insight_missing(spark, sf_dir):
    return rounded(insights.missing(blanked_orders(spark, sf_dir)), 6, "missing_percentage")


def insight_correlation(spark, sf_dir):
    """All pairs of the line item's amounts, one of them derived and one constant."""
    line = load(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"), F.lit(1.0).alias("constant"))
    found = rounded(insights.correlations(line), 6, "r")
    return found.withColumn("is_high", F.abs("r") > 0.7)


def insight_outliers(spark, sf_dir):
    return union_all([insights.outlier_share(load(spark, sf_dir, "events"), ["value"]),
                      insights.outlier_share(load(spark, sf_dir, "documents"), ["n_chars"])])


def insight_cardinality(spark, sf_dir):
    return union_all([insights.high_cardinality(load(spark, sf_dir, t)) for t in ("customer", "part", "documents")])


def insight_imbalance(spark, sf_dir):
    """Flags that nearly always or half of the time have one value."""
    line = load(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") >= 48, "bulk").otherwise("normal").alias("size"),
        F.when(F.col("l_discount") > 0, "reduced").otherwise("full").alias("price"), "l_linestatus")
    return rounded(insights.imbalance(line), 6, "top_percentage")


def trend_slope(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("amount", scalars.money(F.col("o_totalprice")))
    found = insights.trend(orders, "o_orderdate", "amount")
    return found.select("periods", F.round("slope", 3).alias("slope"), F.round("r2", 6).alias("r2"),
                        F.round("mean_total", 3).alias("mean_total"))


# --- measures, time intelligence, visuals ------------------------------------------------

def measure_basic(spark, sf_dir):
    orders = blanked_orders(spark, sf_dir).withColumn("price", scalars.money(F.col("o_totalprice")))
    found = measures(orders, [
        Measure("price", "SUM", "total_price"), Measure("o_totalprice", "AVERAGE", "average_price"),
        Measure("o_totalprice", "COUNT", "price_count"), Measure("o_orderpriority", "DISTINCTCOUNT", "priorities")],
        ["o_orderstatus"])
    return rounded(found.withColumn("total_price", F.col("total_price").cast("double")), 4, "average_price")


def visual_minmax(spark, sf_dir):
    return measures(load(spark, sf_dir, "orders"), [
        Measure("o_totalprice", "MIN", "smallest"), Measure("o_totalprice", "MAX", "largest")], ["o_orderpriority"])


def format_measures(spark, sf_dir):
    """Totals per return flag as display text."""
    line = load(spark, sf_dir, "lineitem")
    totals = line.groupBy("l_returnflag").agg(
        F.sum(scalars.money(F.col("l_extendedprice"))).alias("total_price"),
        F.sum(scalars.money(F.col("l_quantity"))).cast("bigint").alias("quantity"),
        (F.sum((F.col("l_discount") > 0.05).cast("int")) / F.count("*")).alias("discount_rate"),
        F.max("l_shipdate").alias("last_ship"))
    show = formats.format_measure
    return totals.select(
        "l_returnflag", show(F.col("total_price"), "total_price", "decimal").alias("total_price"),
        show(F.col("quantity"), "quantity", "bigint").alias("quantity"),
        show(F.col("discount_rate"), "discount_rate", "double").alias("discount_rate"),
        show(F.col("last_ship"), "last_ship", "timestamp").alias("last_ship"))


def timed(spark, sf_dir):
    found = time_intelligence(load(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"],
                              scalars.money(F.col("o_totalprice")))
    amounts = {c: F.col(c).cast("double") for c in ("value", "prior_year", "ytd", "pytd")}
    return rounded(found.withColumns(amounts | {c: F.col(c).cast("bigint") for c in ("year", "period")}), 6, "yoy")


def measure_prior_year(spark, sf_dir):
    return timed(spark, sf_dir).select("o_orderpriority", "year", "period", "value", "prior_year")


def measure_yoy(spark, sf_dir):
    return timed(spark, sf_dir).select("o_orderpriority", "year", "period", "yoy")


def measure_ytd(spark, sf_dir):
    return timed(spark, sf_dir).select("o_orderpriority", "year", "period", "ytd")


def measure_pytd(spark, sf_dir):
    return timed(spark, sf_dir).select("o_orderpriority", "year", "period", "ytd", "pytd")


def visual_bundle_page(spark, sf_dir):
    orders = orders_with_revenue(spark, sf_dir, "o_custkey", "o_orderdate", "o_orderpriority")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region")
    page = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey))
    found = visual_bundle(page, [
        Measure(F.col("revenue"), "SUM", "Revenue"), Measure(F.col("units"), "SUM", "Units"),
        Measure("o_orderkey", "COUNT", "Orders")], "o_orderdate", "o_orderpriority", "r_name")
    return rounded(found.withColumn("priority", F.col("priority").cast("bigint")), 6, "value")


def date_dimension(spark, sf_dir):
    """The calendar of the orders with the orders of each day."""
    orders = load(spark, sf_dir, "orders")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("order_count"))
    days = dates.date_dimension_for(orders, "o_orderdate").join(daily, "date", "left")
    whole = {c: F.col(c).cast("bigint") for c in ("year", "month", "day", "day_of_week", "week_of_year")}
    return days.withColumns(whole | {"order_count": F.coalesce("order_count", F.lit(0))})


# --- rows, text, learning ----------------------------------------------------------------

def retain_last_n(spark, sf_dir):
    return rows.retain_last(load(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")],
                            100).select("event_type", "event_id", "user_id", "value")


def redact_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.redact(F.col("text")).alias("text"))


def label_encode(spark, sf_dir):
    coded = ml.label_encode(blanked_orders(spark, sf_dir), "o_orderpriority", "code")
    return coded.groupBy("o_orderpriority", "code").agg(F.count("*").alias("row_count"))


def train_test_split(spark, sf_dir):
    fit, test = ml.train_test_split(load(spark, sf_dir, "orders"), ["o_orderkey"])
    return union_all([d.select("o_orderkey", F.lit(n).alias("part")) for n, d in (("train", fit), ("test", test))])


def regression_metrics(spark, sf_dir):
    """How well a flat price per unit explains the price of a line."""
    line = load(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500.0)
    found = ml.regression_metrics(line, "l_extendedprice", "predicted")
    return found.select("n", F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


GUARDED = """
    WITH urgent AS (SELECT o_custkey, o_totalprice AS created_value FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT c_mktsegment, count(*) AS order_count, CAST(sum(CAST(created_value AS DECIMAL(18,4))) AS DOUBLE) AS total
    FROM urgent JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
"""


def guarded_query(spark, sf_dir):
    return guarded_sql(spark, GUARDED, load_all(spark, sf_dir, ("orders", "customer")))


# --- streams -----------------------------------------------------------------------------

EVENT_RECORD = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream_config(spark, sf_dir) -> dict:
    # a pattern, since a stream's path may otherwise be a folder only
    return {"type": "files", "name": "events", "format": "parquet", "path": f"{sf_dir}/{{events}}.parquet",
            "schema": load(spark, sf_dir, "events").schema, "required": ("event_id",)}


def stream_process_events(spark, sf_dir):
    """Events as JSON records through a processor into parquet, run to the end of the input."""
    def enrich(df: DataFrame) -> DataFrame:
        return df.select("event_id", "event_type", F.to_date("ts").alias("day"),
                         F.round(F.col("value") * 2, 2).alias("doubled"))

    sink = scratch(spark, "stream")
    query = runner.run_stream(spark, event_stream_config(spark, sf_dir), EVENT_RECORD, sink, f"{sink}/offsets",
                              {"events": enrich}, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{sink}/records").drop("batch")


def stream_counts(spark, sf_dir):
    """Processed and failed records of a stream in which the texts of error events are cut."""
    raw = runner.read_stream(spark, event_stream_config(spark, sf_dir))
    cut = F.when(F.col("value").contains('"event_type":"error"'), F.substring("value", 1, 20)).otherwise(F.col("value"))
    counts = runner.record_counts(runner.decode(raw.withColumn("value", cut), EVENT_RECORD, ("event_id",)))
    sink = scratch(spark, "stream")
    runner.run_totals(counts, f"{sink}/states", f"{sink}/offsets", available_now=True).awaitTermination()
    return runner.newest_state(spark, f"{sink}/states")


def stream_hourly_rate(spark, sf_dir):
    raw = runner.read_stream(spark, event_stream_config(spark, sf_dir))
    events = runner.good_records(runner.decode(raw, EVENT_RECORD))
    rates = runner.stream_rates(events, "ts", by=("event_type",))
    sink = scratch(spark, "stream")
    keys = ("window_start", "event_type")
    runner.run_totals(rates, f"{sink}/states", f"{sink}/offsets", True, keys).awaitTermination()
    return runner.newest_state(spark, f"{sink}/states", keys).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def measure_table(spark, sf_dir):
    """Measures as rows with their format and category."""
    specs = [Measure("l_quantity"), Measure("l_extendedprice"), Measure("l_tax", "AVERAGE", "Average Tax Rate")]
    found = measures(load(spark, sf_dir, "lineitem"), specs)
    return rounded(measure_rows(found, specs), 2, "value")


OPERATOR_QUERIES = {
    f.__name__: f for f in (
        scan_csv_roundtrip, scan_json_multi, union_files, flatten_json_props, project_filter_limit, sample_rows,
        cast_plan_events, cast_rows_events, filter_last_12_months, visual_table, chunk_summary, natural_join_fold,
        detect_key_columns, classify_tables, suggest_measures_dims, infer_relationships, relationship_cardinality,
        relationship_cycles, model_score, verify_primary_key, fk_orphans, upsert_customers, catalog_columns,
        catalog_row_counts, catalog_summary, schema_drift_diff, catalog_set_ops, table_relevance, model_complexity,
        profile_dataset, profile_nulls, profile_distinct, profile_numeric, profile_moments, profile_top_values,
        profile_text, profile_datetime, describe_numeric, outliers_zscore, outliers_iqr, quality_issues,
        quality_score, rule_type_consistency, rule_negative_values, rule_column_pattern, insight_missing,
        insight_correlation, insight_outliers, insight_cardinality, insight_imbalance, trend_slope, measure_basic,
        visual_minmax, format_measures, measure_prior_year, measure_yoy, measure_ytd, measure_pytd, date_dimension,
        retain_last_n, redact_documents, label_encode, train_test_split, regression_metrics, stream_process_events,
        stream_counts, stream_hourly_rate, measure_table)
} | {"visual_bundle": visual_bundle_page, "guarded_sql": guarded_query}
