"""Streams with state as queries: events seen once, sessions, and profiles merged over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import sketches
from quillon.operators.profile import column_counts, numeric_columns
from quillon.plans.operator_queries import EVENT_RECORD, event_stream_config
from quillon.session import load, scratch
from quillon.streaming import runner, sessions

WATERMARK = "1 hour"
GAP_HOURS = 6
#: Size of the row groups of a batch's file: a group is read by one task.
ROW_GROUP_BYTES = 4 << 20


def resent_events(spark, sf_dir) -> DataFrame:
    """The events as a stream in which every tenth is sent twice."""
    def events() -> DataFrame:
        raw = runner.read_stream(spark, event_stream_config(spark, sf_dir))
        return runner.good_records(runner.decode(raw, EVENT_RECORD, ("event_id",)))

    return events().union(events().where("event_id % 10 = 0"))


def appended(spark, df: DataFrame) -> DataFrame:
    """What a stream has appended when its input is at its end."""
    sink = scratch(spark, "stream")
    sessions.run_appended(df, f"{sink}/rows", f"{sink}/offsets", available_now=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{sink}/rows")


def stream_distinct_events(spark, sf_dir):
    """Events by type after those that were sent again are dropped."""
    once = sessions.seen_once(sessions.timed(resent_events(spark, sf_dir), "ts", WATERMARK), ["event_id"])
    return appended(spark, once).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")],
                        "events", F.round("total", 2).alias("total"))


def stream_sessions(spark, sf_dir):
    """Sessions of users that are over when the stream has read all events, each event counted once."""
    once = sessions.seen_once(sessions.timed(resent_events(spark, sf_dir), "ts", WATERMARK), ["event_id"])
    return _shown(appended(spark, sessions.session_totals(once, "ts", ["user_id"], f"{GAP_HOURS} hours", "value")))


def stream_keyed_sessions(spark, sf_dir):
    """The same sessions from state that each user keeps, without events that are sent again."""
    events = runner.good_records(runner.decode(runner.read_stream(spark, event_stream_config(spark, sf_dir)), EVENT_RECORD, ("event_id",)))
    found = sessions.keyed_sessions(sessions.timed(events, "ts", WATERMARK), "ts", "user_id", "value", GAP_HOURS * 3600)
    return _shown(appended(spark, found))


def batched_events(spark, sf_dir, files: int = 4) -> DataFrame:
    """The events as a stream of one file a batch, in row groups small enough that many tasks read a file."""
    path = scratch(spark, "inbox")
    events = load(spark, sf_dir, "events")
    events.repartition(files, "event_id").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    config = {**event_stream_config(spark, sf_dir), "path": path, "files_per_batch": 1}
    return runner.good_records(runner.decode(runner.read_stream(spark, config), EVENT_RECORD, ("event_id",)))


def stream_sketch_profile(spark, sf_dir):
    """Sketches of the batches of a stream, merged, beside the exact profile: counts, and whether estimates are within their bounds."""
    sink = scratch(spark, "stream")
    runner.run_profiled(batched_events(spark, sf_dir), f"{sink}/profile", f"{sink}/offsets", available_now=True).awaitTermination()
    report = sketches.sketch_report(runner.merged_sketches(spark, f"{sink}/profile"))
    events = load(spark, sf_dir, "events")
    exact = column_counts(events).select("column", F.col("unique_count").alias("exact"))
    numbers = numeric_columns(events)
    medians = report.where(F.col("median").isNotNull()).select(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    # the share of rows below, and up to, the estimated median
    ranks = events.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.avg((F.col(c) < medians[c]).cast("int")).alias("below"), F.avg((F.col(c) <= medians[c]).cast("int")).alias("upto"))
        for c in numbers]).alias("cells")).select(F.inline("cells"))
    batches = spark.read.parquet(f"{sink}/profile").agg(F.count_distinct("batch")).scalar()
    near = F.abs(F.col("unique_count") - F.col("exact")) <= sketches.distinct_error() * F.col("exact") + 1
    middle = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    return report.join(exact, "column").join(ranks, "column", "left").select(
        "column", "row_count", "null_count", near.alias("distinct_within"), middle.alias("median_within"), batches.alias("batches"))


def stream_heavy_values(spark, sf_dir):
    """The most frequent event types and users by the merged frequent-item sketches of a stream's batches. Columns of fewer values than
    the sketch holds are counted exactly."""
    sink = scratch(spark, "stream")
    runner.run_profiled(batched_events(spark, sf_dir), f"{sink}/profile", f"{sink}/offsets", available_now=True).awaitTermination()
    report = sketches.sketch_report(runner.merged_sketches(spark, f"{sink}/profile"), 5)
    return report.where("column IN ('event_type', 'props')").select("column", F.inline("top_values")).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("most"))


STREAM_QUERIES = {f.__name__: f for f in (
    stream_distinct_events, stream_sessions, stream_keyed_sessions, stream_sketch_profile, stream_heavy_values)}
