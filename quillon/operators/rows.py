"""Row-level operators: samples, chunks, retention, upserts and chunk functions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from quillon.functions.types import numeric_columns, value_or_null
from quillon.session import scratch

RETAIN_PARTS = 64


def sample(df: DataFrame, n: int = 1000, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with an order the same rows every time."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def with_row_number(df: DataFrame, order_by: str, name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in the order of a column, without a sort in one task.

    Rows are range-partitioned by the column and a hash of the row, so that a value held by
    many rows spreads over several tasks, and sorted and numbered inside their partition. The
    result is written to the shared folder: the offsets of the partitions and the rows then
    come from the same ranges, also when an executor is lost. Equal values are numbered in
    a repeatable but unspecified order.
    """
    spark = df.sparkSession
    path = scratch(spark, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("__spread", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    keys = [F.col(f"`{order_by}`").asc_nulls_first(), F.col("__spread").asc()]
    (ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__spread")
     .withColumn("__id", F.monotonically_increasing_id()).write.parquet(path))
    # an id is the partition number in the upper bits and the row's place in the lower 33
    placed = spark.read.schema(ordered.drop("__spread").withColumn("__id", F.lit(0).cast("bigint")).schema).parquet(path)
    placed = placed.withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id") % (1 << 33)})
    # one row per partition: the window over all of them and the broadcast are bounded
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("__part").agg(F.count("*").alias("__rows")).select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__shift"))
    return (placed.join(F.broadcast(shift), "__part")
            .withColumn(name, F.col("__place") + F.col("__shift") + 1).drop("__part", "__place", "__shift", "__id"))


def with_chunks(df: DataFrame, order_by: str, chunk_size: int = 10_000) -> DataFrame:
    """Add ``chunk``: consecutive slices of ``chunk_size`` rows, counted from 0."""
    return (with_row_number(df, order_by, "__number")
            .withColumn("chunk", F.floor((F.col("__number") - 1) / chunk_size).cast("bigint"))
            .drop("__number"))


def chunk_summary(df: DataFrame, order_by: str, chunk_size: int = 5000,
                  columns: list[str] | None = None) -> DataFrame:
    """Rows ``(chunk, column, count, mean, std, min, median, max)``, a summary per slice."""
    columns = columns or numeric_columns(df)
    cells = []
    for c in columns:
        v = value_or_null(df, c).cast("double")
        # a chunk has a fixed number of rows, so the built-in exact median is bounded
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.median(v).alias("median"),
            F.max(v).alias("max")))
    chunks = with_chunks(df.select(*dict.fromkeys([order_by, *columns])), order_by, chunk_size)
    return chunks.groupBy("chunk").agg(F.array(*cells).alias("cells")).select("chunk", F.inline("cells"))


def retain_last(df: DataFrame, key: list[str], order: list[Column], n: int = 100) -> DataFrame:
    """The first ``n`` rows of every key in the given (descending) order.

    Up to 1000, Spark itself keeps ``n`` rows of a key per task before the shuffle. Beyond, the rows
    of a key are first ranked in parts by a hash of the row, and only the first ``n`` of
    each part go on, so that a hot key is not sorted whole in one task.
    """
    if n > 1000:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(RETAIN_PARTS))
        within = Window.partitionBy(*key, "__part").orderBy(*order)
        df = df.withColumn("__part", part).withColumn("__rank", F.row_number().over(within)).where(
            F.col("__rank") <= n).drop("__part", "__rank")
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= n).drop("__rank")


def latest(df: DataFrame, keys: list[str], order_by: str | None) -> DataFrame:
    """One row per key: the one with the largest order value."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*([order_by] if order_by else []), *[c for c in rest if c != order_by])
    best = F.max_by(F.struct(*rest), order).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """The target with rows replaced or added by key; the last update of a key wins."""
    fresh = latest(updates, keys, order_by)
    kept = target.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def map_chunks(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               chunk_size: int = 10_000, on_error: str = "raise", errors=None) -> DataFrame:
    """Apply a pandas function to slices of each partition and unite the results.

    A slice that fails also fails the job. With ``on_error='skip'`` its rows are left out and
    logged (and the slice is counted in the accumulator ``errors`` if one is given, again with every retry).
    """
    if on_error not in ("skip", "raise"):
        raise ValueError("on_error must be 'skip' or 'raise'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk_size):
                try:
                    yield func(batch.iloc[start:start + chunk_size].reset_index(drop=True))
                except Exception:
                    if on_error == "raise":
                        raise
                    logging.getLogger(__name__).exception("a chunk failed and is left out")
                    if errors is not None:
                        errors.add(1)

    return df.mapInPandas(run, schema)


def map_chunks_apart(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                     chunk_size: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(result, failed)`` of a pandas function on slices of each partition: what it made, and the slices on which it failed.

    ``failed`` has ``partition, slice, rows, message, records``, a row per slice, ``records`` its rows as JSON text: none is lost. Both come
    from one run that is written to the shared folder, so they fit together and stay so when tasks are tried again.
    """
    kept = StructType.fromDDL(schema)
    side = StructType.fromDDL("partition int, slice int, rows bigint, message string, records array<string>")
    both = StructType([*[StructField(f.name, f.dataType) for f in kept], StructField("__failed", side)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, len(batch), chunk_size):
                chunk = batch.iloc[start:start + chunk_size].reset_index(drop=True)
                try:
                    out = func(chunk.copy())[kept.names].assign(__failed=None)
                except Exception as error:
                    records = chunk.to_json(orient="records", lines=True, date_format="iso").splitlines()
                    out = pd.DataFrame({**{n: [None] for n in kept.names}, "__failed": [{
                        "partition": part, "slice": number, "rows": len(chunk), "message": f"{type(error).__name__}: {error}", "records": records}]})
                number += 1
                yield out

    path = scratch(df.sparkSession, "chunks")
    df.mapInPandas(run, both).write.parquet(path)
    made = df.sparkSession.read.schema(both).parquet(path)
    return made.where("__failed IS NULL").drop("__failed"), made.where("__failed IS NOT NULL").select("__failed.*")
