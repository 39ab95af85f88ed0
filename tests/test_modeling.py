import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog, drift, lineage, modeling, natural_join
from tests.conftest import rows

SCHEMA = catalog.CATALOG_SCHEMA


def cat(spark, *entries):
    """Catalog rows from ``table.column type``, nullable unless marked ``!``."""
    out, seen = [], {}
    for e in entries:
        name, kind = e.split(" ", 1)
        table, column = name.split(".")
        seen[table] = seen.get(table, 0) + 1
        out.append((table, column, kind.rstrip("!"), not kind.endswith("!"), seen[table]))
    return catalog.local_frame(spark, out, SCHEMA)


def test_natural_join_meets_missing_keys_and_skips_strangers(spark):
    a = spark.createDataFrame([(1, 10), (None, 20)], "k int, v int")
    b = spark.createDataFrame([(1, 100), (None, 200)], "k int, w int")
    c = spark.createDataFrame([(5,)], "other int")
    joined, skipped = natural_join.natural_join({"a": a, "b": b, "c": c})
    assert joined.columns == ["k", "v", "w"] and skipped == ["c"]
    assert rows(joined) == [(None, 20, 200), (1, 10, 100)]
    assert rows(natural_join.natural_join({"a": a, "b": b}, null_safe=False)[0]) == [(1, 10, 100)]
    assert rows(natural_join.natural_join({"a": a, "b": b}, drop_null_keys=True)[0]) == [(1, 10, 100)]


def test_a_join_that_would_explode_raises(spark):
    a = spark.range(300).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("v"))
    b = a.withColumnRenamed("v", "w")
    assert natural_join.join_size(a, b, ["k"]) == {"left": 300, "right": 300, "joined": 90_000, "missing": 90_000, "most": 90_000}
    with pytest.raises(natural_join.JoinTooLarge, match="90000, 90000 of"):
        natural_join.natural_join({"a": a, "b": b})
    assert natural_join.natural_join({"a": a, "b": b}, drop_null_keys=True)[0].count() == 0
    assert natural_join.natural_join({"a": a, "b": b}, null_safe=False)[0].count() == 0
    assert natural_join.natural_join({"a": a, "b": b}, max_growth=None)[0].count() == 90_000
    many = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    with pytest.raises(natural_join.JoinTooLarge):
        natural_join.natural_join({"a": many, "b": many.withColumnRenamed("id", "w")})
    assert natural_join.natural_join({"a": many, "b": spark.range(3).withColumnRenamed("id", "k")})[0].count() == 300


def test_natural_join_on_all_shared_names_stays_an_equi_join(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, l int, v string")
    b = spark.createDataFrame([(1, 2, "z")], "k int, l int, w string")
    joined, _ = natural_join.natural_join({"a": a, "b": b})
    assert rows(joined) == [(1, 2, "y", "z")]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_schema_diff_has_one_row_per_change(spark):
    old = cat(spark, "t.a int", "t.b string", "t.n int!", "gone.x int", "gone.y int")
    new = cat(spark, "t.a bigint", "t.c date", "t.n int", "fresh.z int", "fresh.w int")
    got = rows(drift.schema_diff(old, new).select("type", "table", "column", "old_type", "new_type", "severity"))
    assert got == [
        ("column_added", "t", "c", None, None, "info"), ("column_removed", "t", "b", None, None, "warning"),
        ("column_type_changed", "t", "a", "int", "bigint", "warning"), ("table_added", "fresh", None, None, None, "info"),
        ("table_removed", "gone", None, None, None, "warning")]
    extra = drift.schema_diff(old, new, nullable=True).where("type = 'nullable_changed'")
    assert [(r.table, r.column) for r in extra.collect()] == [("t", "n")]


def test_schema_hash_ignores_row_order(spark):
    one, two = cat(spark, "t.a int", "u.b int"), cat(spark, "u.b int", "t.a int")
    assert drift.schema_hash(one).first() == drift.schema_hash(two.orderBy("table")).first()
    assert drift.schema_hash(one).first() != drift.schema_hash(cat(spark, "t.a int", "u.b date")).first()


def test_drift_against_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    first, second = cat(spark, "t.a int"), cat(spark, "t.a int", "t.b int")
    known, changes = drift.detect_drift(spark, path, "s", first)
    assert (known, changes.count()) == (False, 0)
    known, changes = drift.detect_drift(spark, path, "s", second)
    assert known and [(r.type, r.column) for r in changes.collect()] == [("column_added", "b")]
    known, changes = drift.detect_drift(spark, path, "s", second)
    assert known and changes.count() == 0
    assert drift.detect_drift(spark, path, "other", first)[0] is False
    assert drift.detect_drift(spark, path, "s", first, max_age_seconds=-1)[0] is False


def test_catalog_sets(spark):
    got = rows(drift.catalog_sets(cat(spark, "t.a int", "t.b int"), cat(spark, "t.b int", "u.c int"))
               .select("table", "column", "membership"))
    assert got == [("t", "a", "only_old"), ("t", "b", "both"), ("u", "c", "only_new")]


def test_catalog_of_frames(spark):
    tables = {"t": spark.createDataFrame([(1, None), (2, "x")], "a int, b string")}
    got = rows(catalog.catalog_with_counts(spark, tables).select("table", "column", "type", "position", "row_count", "value_count"))
    assert got == [("t", "a", "int", 1, 2, 2), ("t", "b", "string", 2, 2, 1)]


def test_summary_cuts_columns_and_the_narrowest_tables(spark):
    names = [f"wide.c{i:02d} int" for i in range(25)] + ["b.x int", "a.x int"]
    got = catalog.summarize_catalog(cat(spark, *names), max_tables=2)
    assert got.groupBy("table").count().orderBy("table").collect() == [("a", 1), ("wide", 20)]


def test_relevance_counts_repeats_and_business_words(spark):
    c = cat(spark, "sales.region_id int", "sales.amount int", "notes.body string", "region.region_id int")
    got = rows(catalog.rank_tables_for(spark, c, "Region region id"), "rank")
    # sales: 2 x region + id in one column, and a business word; region: 2 x 2 in the name, 2 + 1 in the column
    assert [(r[0], r[1]) for r in got] == [("region", 7), ("sales", 6)]


def test_model_size_uses_real_rows(spark):
    got = catalog.model_size({"t": spark.range(5000).toDF("a")}, 2).first()
    assert (got.row_count, got.cell_count, got.complexity_score, got.size_estimate_mb) == (5000, 5000, 5, 5)


def test_key_names(spark):
    c = cat(spark, "t.customer_id int", "t.width int", "t.paid int", "t.id int", "t.o_orderkey int", "t.pk int")
    plain = {(r.column, r.category) for r in modeling.detect_keys(c).collect()}
    assert plain == {("customer_id", "primary_key"), ("customer_id", "foreign_key_candidate"), ("id", "primary_key"),
                     ("o_orderkey", "primary_key"), ("o_orderkey", "foreign_key_candidate"), ("pk", "primary_key")}
    legacy = {(r.column, r.category) for r in modeling.detect_keys(c, legacy=True).collect()}
    assert ("width", "primary_key") in legacy and ("paid", "foreign_key_candidate") in legacy


def test_suggested_fields(spark):
    c = cat(spark, "t.l_discount double", "t.total_amount double", "t.tax_rate double", "t.avg_price float",
            "t.order_date timestamp", "t.city varchar", "t.product_type string", "t.name text", "t.flag boolean")
    got = {r.column: (r.role, r.suggestion) for r in modeling.suggest_fields(c).collect()}
    assert got == {"total_amount": ("measure", "SUM"), "avg_price": ("measure", "SUM"), "order_date": ("dimension", "time"),
                   "city": ("dimension", "geography"), "product_type": ("dimension", "category"),
                   "name": ("dimension", "attribute")}
    assert "l_discount" in {r.column for r in modeling.suggest_fields(c, legacy=True).collect()}


def test_star_by_names(spark):
    c = cat(spark, "sales.sale_id int", "sales.customer_id int", "sales.productid int", "sales.amount double",
            "customer.customer_id int", "customer.name string", "product.id int", "product.label string")
    keys = modeling.detect_keys(c, fk_suffixes=("_id", "id"))
    tables, edges = modeling.infer_star(c, keys)
    kinds = {r.table: (r.kind, r.primary_key) for r in tables.collect()}
    assert kinds == {"sales": ("fact", "sale_id"), "customer": ("dimension", "customer_id"), "product": ("dimension", "id")}
    assert rows(edges) == [("sales", "customer_id", "customer", "customer_id", "many_to_one"),
                           ("sales", "productid", "product", "id", "many_to_one")]
    assert modeling.star_compliance(c, keys, edges).first().is_compliant


def test_keys_orphans_and_cardinality(spark):
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None), (5, 9)], "id int, parent_id int")
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string")
    assert rows(modeling.verify_primary_key(child, ["id"])) == [("id", 5, 5, 0, True)]
    assert rows(modeling.verify_primary_key(child, ["parent_id"])) == [("parent_id", 5, 2, 1, False)]
    assert rows(modeling.fk_orphans(child, "parent_id", parent, "id")) == [(9, 2)]
    assert rows(modeling.fk_matched(child, "parent_id", parent, "id")) == [(1, 2)]
    edge = {"from_table": "c", "from_column": "parent_id", "to_table": "p", "to_column": "id"}
    back = {"from_table": "p", "from_column": "id", "to_table": "c", "to_column": "parent_id"}
    tables = {"c": child, "p": parent}
    got = {r.from_table: r for r in modeling.cardinality(tables, [edge, back]).collect()}
    assert (got["c"].cardinality, got["p"].cardinality, got["c"].from_largest) == ("many_to_one", "one_to_many", 2)
    held = {r.from_table: (r.matched_rows, r.orphan_rows) for r in modeling.inclusion(tables, [edge, back]).collect()}
    assert held == {"c": (2, 2), "p": (1, 1)}


@pytest.fixture
def unmerged(spark, monkeypatch):
    """Shuffle partitions are left as they are, and a task is meant to take 50 keys."""
    monkeypatch.setattr(modeling, "KEYS_A_TASK", 50, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keys_are_counted_in_tasks_of_bounded_size(spark, unmerged):
    tables = {"t": spark.range(2000).select((F.col("id") * 2).alias("id"), (F.col("id") % 3).alias("few_id"), F.lit(None).cast("int").alias("no_id")), "u": spark.range(0)}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    counted = modeling.counted_keys(tables, {"t": ["id", "few_id", "no_id"], "u": ["id"]})
    assert spark.conf.get("spark.sql.shuffle.partitions") == parts
    # four shuffle partitions alone would hold 500 keys each
    assert counted.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 120
    profile = modeling.key_profile(tables, {"t": ["id", "few_id", "no_id"], "u": ["id"]}, counted)
    assert rows(profile.drop("is_unique"), "table", "column") == [
        ("t", "few_id", 2000, 0, 3, 667), ("t", "id", 2000, 0, 2000, 1), ("t", "no_id", 2000, 2000, 0, None), ("u", "id", 0, 0, 0, None)]


def test_edges_are_joined_in_tasks_of_bounded_size(spark, unmerged):
    child, parent = spark.range(1000).select((F.col("id") * 2).alias("p")), spark.range(1000)
    edge = {"from_table": "c", "from_column": "p", "to_table": "p", "to_column": "id"}
    held = modeling.inclusion({"c": child, "p": parent}, [edge])
    # 1000 keys on either side at 50 a task
    assert held._jdf.queryExecution().optimizedPlan().toString().count(", 41") == 2
    assert [(r.matched_rows, r.orphan_rows) for r in held.collect()] == [(500, 500)]


def edges_of(spark, text):
    pairs = [tuple(p.split(">")) for p in text.split()]
    return spark.createDataFrame([(a, "k", b, "k", "many_to_one") for a, b in pairs],
                                 "from_table string, from_column string, to_table string, to_column string, cardinality string")


@pytest.mark.parametrize("edges, cycles", [
    ("a>b b>c c>a x>y", {("a -> b -> c -> a", 3)}), ("a>b b>c a>c", set()), ("a>a", {("a -> a", 1)}),
    ("b>a a>b b>c c>b", {("a -> b -> a", 2), ("b -> c -> b", 2)}),
])
def test_cycles(spark, edges, cycles):
    assert set(rows(modeling.relationship_cycles(edges_of(spark, edges)))) == cycles


def test_model_score(spark):
    tables = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "table string, has_key boolean")
    edges = edges_of(spark, "a>b b>a").withColumn("cardinality", F.lit("many_to_many"))
    compliance = spark.createDataFrame([(False,)], "is_compliant boolean")
    got = modeling.validate_model(tables, edges, modeling.relationship_cycles(edges), compliance).first()
    assert (got.cycles, got.many_to_many, got.tables_without_key, got.score) == (1, 2, 2, 100 - 20 - 20 - 10 - 5)


def test_lineage_keeps_the_newest_entries(spark, tmp_path):
    path = str(tmp_path / "lineage")
    for i in range(4):
        lineage.append_lineage(spark, path, "a", f"step {i}", i)
    lineage.append_lineage(spark, path, "b", "only")
    got = rows(lineage.recent_lineage(spark, path, 2).select("source", "operation"))
    assert got == [("a", "step 2"), ("a", "step 3"), ("b", "only")]
