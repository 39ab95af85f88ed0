"""Catalog frames: which tables and columns exist, how large they are, which fit a question."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.functions.scalars import words
from quillon.functions.types import value_or_null

CATALOG_SCHEMA = "table string, column string, type string, nullable boolean, position int"

# Words of business tables and the points of the relevance score.
BUSINESS_WORDS = ("sales", "revenue", "customer", "product", "order", "transaction")
TABLE_POINTS, COLUMN_POINTS, BUSINESS_POINTS = 2, 1, 3


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of metadata rows with a size the optimizer knows."""
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column from the frames' schemas; reads no data."""
    rows = [
        (table, f.name, f.dataType.simpleString(), f.nullable, i + 1)
        for table, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return local_frame(spark, rows, CATALOG_SCHEMA)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows ``(table, row_count)``; parquet answers this from its footers."""
    return _union([df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table"), "row_count")
                   for t, df in tables.items()])


def column_fill(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows ``(table, column, row_count, value_count)`` with one aggregation per table."""
    frames = []
    for table, df in tables.items():
        cells = [F.struct(F.lit(c).alias("column"), F.count("*").alias("row_count"),
                          F.count(value_or_null(df, c)).alias("value_count")) for c in df.columns]
        frames.append(df.agg(F.array(*cells).alias("cells")).select(F.lit(table).alias("table"), F.inline("cells")))
    return _union(frames)


def catalog_with_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return catalog_of(spark, tables).join(column_fill(tables), ["table", "column"])


def summarize_catalog(catalog_df: DataFrame, max_tables: int = 50, max_cols: int = 20) -> DataFrame:
    """The widest tables (all, when there are not too many) with their first columns."""
    widths = catalog_df.groupBy("table").agg(F.count("*").alias("column_count"))
    # one row per table
    order = Window.orderBy(F.desc("column_count"), "table")
    chosen = widths.withColumn("table_rank", F.row_number().over(order)).where(F.col("table_rank") <= max_tables)
    first = Window.partitionBy("table").orderBy("position")
    return (catalog_df.join(F.broadcast(chosen), "table")
            .withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= max_cols).drop("__rank"))


def name_weights(catalog_df: DataFrame) -> DataFrame:
    """Rows ``(piece, table, weight)``: the points a keyword earns a table.

    A keyword counts when it occurs inside a name, so every substring of every name is
    listed once per name. That turns the containment test into an equi-join whose small
    side depends on the catalog only.
    """
    def pieces(names: DataFrame, points: int) -> DataFrame:
        size = F.char_length("name")
        starts = F.explode(F.sequence(F.lit(1), size)).alias("start")
        cut = names.where(size > 0).select("table", "name", starts)
        ends = F.explode(F.sequence(F.lit(1), F.char_length("name") - F.col("start") + 1)).alias("size")
        return (cut.select("table", "name", "start", ends)
                .select("table", "name", F.substring("name", F.col("start"), F.col("size")).alias("piece"))
                .distinct().select("table", "piece", F.lit(points).alias("points")))

    tables = catalog_df.select("table", F.lower("table").alias("name")).distinct()
    columns = catalog_df.select("table", F.lower("column").alias("name"))
    return (pieces(tables, TABLE_POINTS).unionByName(pieces(columns, COLUMN_POINTS))
            .groupBy("piece", "table").agg(F.sum("points").alias("weight")))


def rank_tables(catalog_df: DataFrame, texts: DataFrame, id_col: str, text_col: str, top: int = 5) -> DataFrame:
    """Rows ``(id, table, score, rank)``: the tables that fit each text best, scores above 0.

    Every occurrence of a keyword counts. Business tables get their extra points for any text.
    """
    weights = name_weights(catalog_df)
    # the words of a text that hit nothing disappear in the join, before any shuffle
    hits = (texts.select(id_col, F.explode(words(F.col(text_col))).alias("piece"))
            .join(weights, "piece").select(id_col, "table", F.col("weight").alias("points")))
    bonus = sum((F.when(F.lower("table").contains(w), BUSINESS_POINTS).otherwise(0) for w in BUSINESS_WORDS), F.lit(0))
    business = (catalog_df.select("table", bonus.cast("bigint").alias("points")).distinct().where("points > 0")
                .agg(F.collect_list(F.struct("table", "points")).alias("tables")))
    extra = texts.select(id_col, F.inline(business.scalar()))
    scores = hits.unionByName(extra).groupBy(id_col, "table").agg(F.sum("points").alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "table")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_tables_for(spark: SparkSession, catalog_df: DataFrame, text: str, top: int = 5) -> DataFrame:
    """The same for one request."""
    request = local_frame(spark, [(1, text)], "request bigint, text string")
    return rank_tables(catalog_df, request, "request", "text", top).drop("request")


# Points per table, column and measure of the complexity score.
TABLE_WEIGHT, COLUMN_WEIGHT, MEASURE_WEIGHT = 2, 0.1, 1.5


def model_size(tables: dict[str, DataFrame], n_measures: int) -> DataFrame:
    """Complexity score (at most 100), rows, cells, and a size estimate from real row counts."""
    widths = {t: len(df.columns) for t, df in tables.items()}
    n_columns = sum(widths.values())
    raw = len(tables) * TABLE_WEIGHT + n_columns * COLUMN_WEIGHT + n_measures * MEASURE_WEIGHT
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])[F.col("table")]
    counts = row_counts(tables).select("row_count", (F.col("row_count") * width).alias("cells"))
    return counts.agg(
        F.count("*").alias("table_count"), F.sum("row_count").cast("bigint").alias("row_count"),
        F.sum("cells").cast("bigint").alias("cell_count")).select(
        "table_count", F.lit(n_columns).cast("bigint").alias("column_count"),
        F.lit(n_measures).cast("bigint").alias("measure_count"), "row_count", "cell_count",
        F.lit(min(100, int(raw))).cast("bigint").alias("complexity_score"),
        F.floor(F.col("cell_count") / 1000.0).cast("bigint").alias("size_estimate_mb"))
