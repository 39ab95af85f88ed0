"""Differences between two catalogs and the snapshots they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def schema_hash(catalog_df: DataFrame) -> DataFrame:
    """One MD5 per catalog, the same for any row order."""
    entry = F.struct(F.col("table").alias("t"), F.col("column").alias("c"), F.col("type").alias("y"),
                     F.col("nullable").alias("n"))
    return catalog_df.agg(F.md5(F.to_json(F.sort_array(F.collect_list(entry)))).alias("schema_hash"))


def schema_diff(old_catalog: DataFrame, new_catalog: DataFrame, nullable: bool = False) -> DataFrame:
    """Rows ``(type, table, column, old_type, new_type, severity)``, one per change.

    A table that appears or goes is one change, without its columns. Changes of
    nullability are reported only on request.
    """
    def side(catalog: DataFrame, mark: str) -> DataFrame:
        return catalog.select("table", "column", F.col("type").alias(f"{mark}_type"),
                              F.col("nullable").alias(f"{mark}_nullable"), F.lit(True).alias(f"in_{mark}"))

    both = side(old_catalog, "old").join(side(new_catalog, "new"), ["table", "column"], "full_outer")
    per_table = Window.partitionBy("table")
    marked = both.withColumns({
        "had": F.max("in_old").over(per_table).isNotNull(), "has": F.max("in_new").over(per_table).isNotNull()})
    kinds = (
        F.when(~F.col("had"), F.lit("table_added"))
        .when(~F.col("has"), F.lit("table_removed"))
        .when(F.col("in_old").isNull(), F.lit("column_added"))
        .when(F.col("in_new").isNull(), F.lit("column_removed"))
        .when(F.col("old_type") != F.col("new_type"), F.lit("column_type_changed")))
    if nullable:
        kinds = kinds.when(F.col("old_nullable") != F.col("new_nullable"), F.lit("nullable_changed"))
    changed = marked.withColumn("type", kinds).where("type IS NOT NULL")
    whole = F.col("type").startswith("table_")
    typed = F.col("type") == "column_type_changed"
    return changed.select(
        "type", "table", F.when(~whole, F.col("column")).alias("column"),
        F.when(typed, F.col("old_type")).alias("old_type"), F.when(typed, F.col("new_type")).alias("new_type"),
        F.when(F.col("type").endswith("_added"), "info").otherwise("warning").alias("severity"),
    ).distinct()


def catalog_sets(old_catalog: DataFrame, new_catalog: DataFrame) -> DataFrame:
    """All rows with ``membership``: columns only in the old, only in the new, or in both catalogs.

    Rows of columns in both come from the new catalog.
    """
    key = ["table", "column"]
    common = old_catalog.select(*key).intersect(new_catalog.select(*key))
    return (
        old_catalog.join(new_catalog.select(*key), key, "left_anti").withColumn("membership", F.lit("only_old"))
        .unionByName(new_catalog.join(old_catalog.select(*key), key, "left_anti")
                     .withColumn("membership", F.lit("only_new")))
        .unionByName(new_catalog.join(common, key, "left_semi").withColumn("membership", F.lit("both"))))


def save_snapshot(catalog_df: DataFrame, path: str, source: str) -> None:
    """Append the catalog of a source with the time it was taken."""
    (catalog_df.withColumns({"source": F.lit(source), "taken_at": F.current_timestamp()})
     .write.mode("append").partitionBy("source").parquet(path))


def latest_snapshot(spark: SparkSession, path: str, source: str, max_age_seconds: int | None = None) -> DataFrame:
    """The newest catalog of a source, no rows if there is none young enough."""
    rows = spark.read.parquet(path).where(F.col("source") == source)
    if max_age_seconds is not None:
        rows = rows.where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("taken_at") <= max_age_seconds)
    newest = Window.partitionBy("source").orderBy(F.desc("taken_at"))
    return (rows.withColumn("__rank", F.rank().over(newest)).where("__rank = 1")
            .drop("__rank", "source", "taken_at"))


def detect_drift(spark: SparkSession, path: str, source: str, catalog_df: DataFrame,
                 nullable: bool = False, max_age_seconds: int | None = None) -> tuple[bool, DataFrame]:
    """``(known, changes)`` against the last snapshot; then the catalog becomes the snapshot.

    ``known`` is false when the source has no usable snapshot, and then there are no changes.
    """
    empty = schema_diff(catalog_df.limit(0), catalog_df.limit(0))
    try:
        old = latest_snapshot(spark, path, source, max_age_seconds)
        # a catalog holds one row per column: small whatever the size of the tables
        known = bool(old.take(1))
    except Exception as error:  # no snapshot table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = False
    changes = empty
    if known:
        found = schema_diff(old, catalog_df, nullable).collect()
        changes = spark.createDataFrame(found, empty.schema) if found else empty
    save_snapshot(catalog_df, path, source)
    return known, changes
