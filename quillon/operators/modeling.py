"""Star schema from a catalog: keys, fields, facts, relationships, and their check on the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import names as N
from quillon.functions.types import spark_family, value_or_null
from quillon.operators.catalog import local_frame, row_counts
from quillon.session import scratch, shuffled_in

#: Distinct keys that one task counts or joins, about.
KEYS_A_TASK = 250_000


def detect_keys(catalog_df: DataFrame, legacy: bool = False, fk_suffixes=("_id", "key")) -> DataFrame:
    """Rows ``(table, column, type, position, category)``; a column may have both categories."""
    name = F.col("column")
    kinds = F.array_compact(F.array(
        F.when(N.is_key_name(name, legacy), F.lit("primary_key")),
        F.when(N.is_foreign_key_name(name, fk_suffixes, legacy), F.lit("foreign_key_candidate"))))
    return catalog_df.select("table", "column", "type", "position", F.explode(kinds).alias("category"))


def suggest_fields(catalog_df: DataFrame, legacy: bool = False) -> DataFrame:
    """Rows ``(table, column, position, type, role, suggestion)``: measures with their
    aggregation, dimensions with their category."""
    name, kind = F.col("column"), F.col("type")
    role = F.when(N.is_measure(name, kind, legacy=legacy), "measure").when(N.is_dimension(kind), "dimension")
    suggestion = F.when(F.col("role") == "measure", N.suggested_aggregation(name)).otherwise(
        N.dimension_category(name, kind))
    return (catalog_df.withColumn("role", role).where("role IS NOT NULL")
            .select("table", "column", "position", "type", "role", suggestion.alias("suggestion")))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(key, rows)``; whole numbers of any width are one type, so that keys compare."""
    key = value_or_null(df, column)
    if spark_family(df.schema[column].dataType) == "integer":
        key = key.cast("bigint")
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("rows"))


def _tasks(keys: int) -> int:
    return keys // KEYS_A_TASK + 1


COUNTED_SCHEMA = "table string, column string, key string, rows bigint"


def counted_keys(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Rows ``(table, column, key, rows)`` of all key columns, counted once and written.

    Every column is read and counted on its own: the file format gives it without the
    others. Whatever is asked about keys later reads this table of distinct keys and not
    the data; a key that a third of all rows hold is one row of it. Keys are spread over as
    many tasks as the rows of the largest table ask for, and written as they come, without a sort.
    """
    spark = next(iter(tables.values())).sparkSession
    frames = [key_counts(tables[t], c).select(F.lit(t).alias("table"), F.lit(c).alias("column"),
                                              F.col("key").cast("string").alias("key"), "rows")
              for t, names in columns.items() for c in names]
    most = row_counts({t: tables[t] for t in columns}).agg(F.max("row_count")).first()[0] or 0
    path = scratch(spark, "keys")
    with shuffled_in(spark, _tasks(most)):
        _union(frames).write.parquet(path)
    return spark.read.schema(COUNTED_SCHEMA).parquet(path)


def key_profile(tables: dict[str, DataFrame], columns: dict[str, list[str]], counted: DataFrame | None = None) -> DataFrame:
    """Rows, missing, distinct values and the largest group of single columns, a row per column.

    ``counted`` is the result of :func:`counted_keys` for at least these columns, if there is one.
    """
    counted = counted if counted is not None else counted_keys(tables, columns)
    asked = local_frame(counted.sparkSession, [(t, c) for t, names in columns.items() for c in names],
                        "table string, column string")
    found = F.col("key").isNotNull()
    sums = counted.groupBy("table", "column").agg(
        F.sum("rows").alias("row_count"), F.coalesce(F.sum(F.when(~found, F.col("rows"))), F.lit(0)).alias("null_count"),
        F.count("key").alias("unique_count"), F.max(F.when(found, F.col("rows"))).alias("largest_group"))
    zero = F.lit(0).cast("bigint")
    unique = (F.col("row_count") == F.col("unique_count")) & (F.col("null_count") == 0)
    return asked.join(sums, ["table", "column"], "left").select(
        "table", "column", *[F.coalesce(c, zero).alias(c) for c in ("row_count", "null_count", "unique_count")],
        "largest_group").withColumn("is_unique", unique)


def verify_primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, rows without a key, and whether the columns identify a row."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    groups = df.groupBy(*columns).agg(F.count("*").alias("rows")).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count_if(~missing).alias("unique_count"),
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("null_count"))
    ok = (F.col("row_count") == F.col("unique_count")) & (F.col("null_count") == 0)
    return groups.select(F.lit(",".join(columns)).alias("key"), "row_count", "unique_count", "null_count",
                         ok.alias("is_primary_key"))


def classify_tables(catalog_df: DataFrame, keys_df: DataFrame, own_keys: DataFrame | None = None,
                    legacy: bool = False) -> DataFrame:
    """Rows ``(table, kind, measure_count, foreign_key_count, primary_key, grain)``.

    A fact has a measure and a foreign key candidate; all other tables are dimensions.
    Columns listed in ``own_keys`` (proven unique) identify their own table and are no
    foreign keys. The grain of a fact is its key columns in order.
    """
    measure = N.is_measure(F.col("column"), F.col("type"), N.FACT_MEASURE_WORDS, legacy)
    foreign = keys_df.where("category = 'foreign_key_candidate'").select("table", "column")
    if own_keys is not None:
        foreign = foreign.join(own_keys.select("table", "column"), ["table", "column"], "left_anti")
    key_names = (keys_df.groupBy("table", "column", "position")
                 .agg(F.bool_or(F.col("category") == "primary_key").alias("named_primary"))
                 .join(foreign.withColumn("is_foreign", F.lit(True)), ["table", "column"], "left"))
    per_table = catalog_df.groupBy("table").agg(F.count_if(measure).alias("measure_count"))
    first = F.when(F.col("named_primary"), F.struct("position", "column"))
    per_key = key_names.groupBy("table").agg(
        F.count("is_foreign").alias("foreign_key_count"), F.min(first)["column"].alias("named_key"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))),
                                 lambda k: k["column"]), ",").alias("key_list"))
    fallback = F.min(F.when(F.lower("column").isin("id", "key") | F.lower("column").endswith("id"),
                            F.struct("position", "column")))["column"]
    by_name = catalog_df.groupBy("table").agg(fallback.alias("fallback_key"))
    joined = per_table.join(per_key, "table", "left").join(by_name, "table", "left")
    is_fact = (F.col("measure_count") > 0) & (F.coalesce("foreign_key_count", F.lit(0)) > 0)
    kind = F.when(is_fact, "fact").otherwise("dimension")
    return joined.select(
        "table", kind.alias("kind"), "measure_count",
        F.coalesce("foreign_key_count", F.lit(0)).alias("foreign_key_count"),
        F.coalesce("named_key", "fallback_key").alias("primary_key"),
        F.when(is_fact, F.col("key_list")).alias("grain"))


def infer_relationships(catalog_df: DataFrame, tables_df: DataFrame, star_only: bool = True,
                        strip_prefix: bool = False, own_keys: DataFrame | None = None) -> DataFrame:
    """Edges ``(from_table, from_column, to_table, to_column, cardinality)`` by name.

    A column refers to a dimension when it is called like the dimension's key,
    ``<table>_<key>`` or ``<table>id``; the first such column counts. ``strip_prefix``
    compares names without a leading one- or two-letter table prefix. Without
    ``star_only`` every table may refer to every other one. With ``own_keys`` (proven
    unique columns) only tables whose key is among them are referred to.
    """
    def bare(col):
        return F.regexp_replace(F.lower(col), "^[a-z]{1,2}_", "") if strip_prefix else F.lower(col)

    targets = tables_df.where("primary_key IS NOT NULL")
    if own_keys is not None:
        proven = own_keys.select("table", F.col("column").alias("primary_key"))
        targets = targets.join(proven, ["table", "primary_key"], "left_semi")
    sources = tables_df
    if star_only:
        targets, sources = targets.where("kind = 'dimension'"), sources.where("kind = 'fact'")
    target = F.lower("table")
    accepted = F.array_distinct(F.array(
        bare(F.col("primary_key")), F.concat(target, F.lit("_"), bare(F.col("primary_key"))),
        F.concat(target, F.lit("id"))))
    wanted = targets.select(F.col("table").alias("to_table"), F.col("primary_key").alias("to_column"),
                            F.explode(accepted).alias("name"))
    offered = catalog_df.join(sources.select("table"), "table").select(
        F.col("table").alias("from_table"), F.col("column").alias("from_column"), "position",
        bare(F.col("column")).alias("name"))
    return (offered.join(wanted, "name").where("from_table <> to_table")
            .groupBy("from_table", "to_table", "to_column")
            .agg(F.min_by("from_column", "position").alias("from_column"))
            .select("from_table", "from_column", "to_table", "to_column",
                    F.lit("many_to_one").alias("cardinality")))


def infer_star(catalog_df: DataFrame, keys_df: DataFrame, own_keys: DataFrame | None = None,
               **options) -> tuple[DataFrame, DataFrame]:
    """``(tables, edges)`` of the star schema the names suggest."""
    tables_df = classify_tables(catalog_df, keys_df, own_keys)
    return tables_df, infer_relationships(catalog_df, tables_df, **options)


EDGE_FIELDS = ("from_table", "from_column", "to_table", "to_column")
EDGE_SCHEMA = "from_table string, from_column string, to_table string, to_column string"


def edge_list(edges_df: DataFrame) -> list[dict]:
    """The edges as dicts; their number is bounded by the columns of the catalog."""
    return [row.asDict() for row in edges_df.select(*EDGE_FIELDS).collect()]


def _edge_columns(edges: list[dict]) -> dict[str, list[str]]:
    columns: dict[str, list[str]] = {}
    for e in edges:
        for end in ("from", "to"):
            names = columns.setdefault(e[f"{end}_table"], [])
            if e[f"{end}_column"] not in names:
                names.append(e[f"{end}_column"])
    return columns


def _edge_frame(tables: dict[str, DataFrame], edges: list[dict]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return local_frame(spark, [tuple(e[f] for f in EDGE_FIELDS) for e in edges], EDGE_SCHEMA)


def cardinality(tables: dict[str, DataFrame], edges: list[dict], counted: DataFrame | None = None) -> DataFrame:
    """The edges with the largest group on either side, their cardinality and filter direction."""
    keys = key_profile(tables, _edge_columns(edges), counted).select("table", "column", "largest_group")

    def side(end: str) -> DataFrame:
        return keys.select(F.col("table").alias(f"{end}_table"), F.col("column").alias(f"{end}_column"),
                           F.col("largest_group").alias(f"{end}_largest"))

    many_from, many_to = F.coalesce("from_largest", F.lit(0)) > 1, F.coalesce("to_largest", F.lit(0)) > 1
    kind = (F.when(many_from & many_to, "many_to_many").when(many_from, "many_to_one")
            .when(many_to, "one_to_many").otherwise("one_to_one"))
    return (_edge_frame(tables, edges).join(side("from"), ["from_table", "from_column"], "left")
            .join(side("to"), ["to_table", "to_column"], "left")
            .select(*EDGE_FIELDS, "from_largest", "to_largest", kind.alias("cardinality"),
                    F.lit("single").alias("filter_direction")))


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows ``(key, row_count)``: foreign keys without a parent.

    The child is counted per key before the join, so a key with very many rows is one row.
    """
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("row_count"))
    return keys.join(parent.select(F.col(pk).alias("key")), "key", "left_anti")


def fk_matched(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows ``(key, row_count)``: foreign keys that have a parent."""
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("row_count"))
    return keys.join(parent.select(F.col(pk).alias("key")), "key", "left_semi")


def inclusion(tables: dict[str, DataFrame], edges: list[dict], counted: DataFrame | None = None) -> DataFrame:
    """The edges with the rows on the ``from`` side that have, or lack, a partner.

    All edges are one join of distinct keys: those of the ``from`` columns, once per edge, with
    those of the ``to`` columns, in as many tasks as there are keys for. Missing keys are left out.
    """
    counted = counted if counted is not None else counted_keys(tables, _edge_columns(edges))
    ends = _edge_frame(tables, edges)
    # a number per key column of the catalog
    sizes = {(r["table"], r["column"]): r["n"] for r in counted.groupBy("table", "column").agg(F.count("key").alias("n")).collect()}
    parts = _tasks(sum(sizes.get((e["from_table"], e["from_column"]), 0) + sizes.get((e["to_table"], e["to_column"]), 0) for e in edges))
    by = ("to_table", "to_column", "key")
    keys = counted.where("key IS NOT NULL").select(F.col("table").alias("t"), F.col("column").alias("c"), "key", "rows")
    child = keys.join(F.broadcast(ends), (F.col("t") == F.col("from_table")) & (F.col("c") == F.col("from_column"))).drop("t", "c")
    parent = keys.join(F.broadcast(ends.select("to_table", "to_column").distinct()),
                       (F.col("t") == F.col("to_table")) & (F.col("c") == F.col("to_column"))).select(
        "to_table", "to_column", "key", F.lit(True).alias("found"))
    both = child.repartition(parts, *by).join(parent.repartition(parts, *by), list(by), "left").groupBy(*EDGE_FIELDS).agg(
        F.sum(F.when(F.col("found"), F.col("rows"))).alias("matched_rows"),
        F.sum(F.when(F.col("found").isNull(), F.col("rows"))).alias("orphan_rows"))
    zero = F.lit(0).cast("bigint")
    return ends.join(both, list(EDGE_FIELDS), "left").select(
        *EDGE_FIELDS, F.coalesce("matched_rows", zero).alias("matched_rows"),
        F.coalesce("orphan_rows", zero).alias("orphan_rows"))


def relationship_cycles(edges_df: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows ``(cycle, length)``: every simple cycle once, from its first table by name.

    A cycle has at most as many steps as there are tables, which is the default depth.
    """
    spark = edges_df.sparkSession
    pairs = sorted({(r.from_table, r.to_table) for r in edges_df.select("from_table", "to_table").collect()})
    depth = max_depth or len({t for pair in pairs for t in pair}) or 1
    edges = local_frame(spark, pairs, "a string, b string")
    return spark.sql(
        """
        WITH RECURSIVE walk(start, here, path, steps) AS (
            SELECT a, b, array(a, b), 1 FROM {edges} WHERE b >= a
            UNION ALL
            SELECT start, b, array_append(path, b), steps + 1
            FROM walk JOIN {edges} ON here = a
            WHERE here <> start AND steps < :depth
              AND (b = start OR (b > start AND NOT array_contains(path, b)))
        )
        SELECT array_join(path, ' -> ') AS cycle, CAST(steps AS BIGINT) AS length
        FROM walk WHERE here = start
        """, args={"depth": depth}, edges=edges)


def star_compliance(catalog_df: DataFrame, keys_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """One row: facts, dimensions, edges from fact to dimension that are not many-to-one, verdict.

    A fact here needs a measure and more than one key column.
    """
    measure = N.is_measure(F.col("column"), F.col("type"), N.FACT_MEASURE_WORDS)
    keys = keys_df.select("table", "column").distinct().withColumn("is_key", F.lit(True))
    per_table = catalog_df.join(keys, ["table", "column"], "left").groupBy("table").agg(
        ((F.count_if(measure) > 0) & (F.count("is_key") > 1)).alias("is_fact"))
    ends = per_table.select(F.col("table").alias("from_table"), F.col("is_fact").alias("from_fact"))
    others = per_table.select(F.col("table").alias("to_table"), F.col("is_fact").alias("to_fact"))
    wrong = (edges_df.join(ends, "from_table").join(others, "to_table")
             .where("from_fact AND NOT to_fact AND cardinality <> 'many_to_one'").agg(F.count("*")))
    ok = (F.col("fact_count") > 0) & (F.col("dimension_count") > 0) & (F.col("invalid_edges") == 0)
    return per_table.agg(
        F.count_if("is_fact").alias("fact_count"), F.count_if(~F.col("is_fact")).alias("dimension_count"),
    ).withColumn("invalid_edges", wrong.scalar()).withColumn("is_compliant", ok)


# Points a model loses per finding.
CYCLE_POINTS, NO_KEY_POINTS, MANY_TO_MANY_POINTS, NOT_STAR_POINTS = 20, 10, 5, 5


def validate_model(tables_with_key: DataFrame, edges_df: DataFrame, cycles_df: DataFrame,
                   compliance_df: DataFrame) -> DataFrame:
    """One row: findings and the score of the model from 0 to 100.

    ``tables_with_key`` has one row per table with a boolean ``has_key``.
    """
    row = tables_with_key.agg(F.count_if(~F.col("has_key")).alias("tables_without_key")).withColumns({
        "many_to_many": edges_df.agg(F.count_if(F.col("cardinality") == "many_to_many")).scalar(),
        "cycles": cycles_df.agg(F.count("*")).scalar(),
        "is_compliant": compliance_df.select("is_compliant").scalar()})
    raw = (100 - F.when(F.col("cycles") > 0, CYCLE_POINTS).otherwise(0)
           - NO_KEY_POINTS * F.col("tables_without_key") - MANY_TO_MANY_POINTS * F.col("many_to_many")
           - F.when(F.col("is_compliant"), 0).otherwise(NOT_STAR_POINTS))
    return row.withColumn("score", F.greatest(F.lit(0), raw).cast("bigint"))
