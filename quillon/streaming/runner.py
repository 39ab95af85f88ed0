"""Streams of JSON records: reading, decoding, processors, counts, rates and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators.profile import frequencies
from quillon.operators.sketches import merge_sketches, sketch_columns
from quillon.sources import log_stream
from quillon.sources.registry import source_spec

Processor = Callable[[DataFrame], DataFrame]
PROCESSORS: dict[str, Processor] = {}

# Fixed value: seconds between checkpoints.
CHECKPOINT_SECONDS = 30

# Times in JSON text keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def register(name: str, func: Processor) -> None:
    """Name a function from frame to frame as the processor of a source."""
    PROCESSORS[name] = func


def processor(name: str) -> Processor:
    if name not in PROCESSORS:
        raise KeyError(f"no processor registered for {name!r}")
    return PROCESSORS[name]


def read_stream(spark: SparkSession, cfg: dict) -> DataFrame:
    """The raw stream of a source: a ``value`` column of JSON text.

    ``kafka`` and ``event_hub`` read their topic from the earliest offset. ``files`` reads
    a folder (``path``, ``format``, ``schema``); its rows become JSON text.
    """
    if cfg["type"] == "files":
        reader = spark.readStream.format(cfg.get("format", "json")).schema(cfg["schema"])
        if cfg.get("glob"):
            reader = reader.option("pathGlobFilter", cfg["glob"])
        if cfg.get("files_per_batch"):
            reader = reader.option("maxFilesPerTrigger", int(cfg["files_per_batch"]))
        rows = reader.load(cfg["path"])
        if cfg.get("format") == "text":
            return rows.select("value")
        return rows.select(F.to_json(F.struct("*"), JSON_TIMES).alias("value"))
    spec = source_spec(cfg)
    if spec.format == "log":
        log_stream.register(spark)
    if spec.kind != "stream":
        raise ValueError(f"{cfg['type']} is not a stream")
    # a batch takes all that has come, unless the configuration has a batch_size
    return spark.readStream.format(spec.format).options(**spec.options(cfg, None)).load().select(
        F.col("value").cast("string").alias("value"))


def decode(raw: DataFrame, schema: StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """``value``, ``record`` and ``failed``: text that is no such object does not stop the stream.

    A record fails if its text is broken or one of the ``required`` fields is missing. The parsed record passes through an
    array of one, which the optimizer does not look through: else every field and check would parse the text again.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    marked = StructType(struct.fields).add("__broken", "string")
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    out = raw.withColumn("record", F.explode(F.array(parsed)))
    failed = F.col("record").isNull() | F.col("record.__broken").isNotNull()
    for name in required:
        failed = failed | F.col(f"record.{name}").isNull()
    return out.withColumn("failed", failed).withColumn("record", F.col("record").dropFields("__broken"))


def good_records(decoded: DataFrame) -> DataFrame:
    return decoded.where("NOT failed").select("record.*")


def failed_records(decoded: DataFrame) -> DataFrame:
    return decoded.where("failed").select("value")


def record_counts(decoded: DataFrame) -> DataFrame:
    """One row: processed and failed records."""
    return decoded.agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed"))


def stream_rates(df: DataFrame, ts: str, window: str = "1 hour", watermark: str = "1 hour",
                 by: tuple[str, ...] = (), arrived: str | None = None) -> DataFrame:
    """Records per window of event time, and with an arrival column the mean and largest lag."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    cells = [F.count("*").alias("records")]
    if arrived:
        lag = (F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(ts)) / 1e6
        cells += [F.avg(lag).alias("mean_lag_seconds"), F.max(lag).alias("max_lag_seconds")]
    grouped = timed.groupBy(F.window(ts, window), *by).agg(*cells)
    return grouped.select(F.col("window.start").alias("window_start"), *by,
                          *[c for c in grouped.columns if c not in ("window", *by)])


def run_stream(spark: SparkSession, cfg: dict, schema: StructType | str, sink: str, checkpoint: str,
               processors: dict[str, Processor] | None = None, available_now: bool = False) -> StreamingQuery:
    """Decode a stream, apply the processor of its ``name``, and append to parquet folders.

    ``sink/records`` gets the processed rows and ``sink/errors`` the texts that failed. Each
    batch writes its own subfolder and overwrites it when it is retried, so a batch that
    runs twice leaves its rows once.
    """
    name = cfg["name"]
    process = (processors or PROCESSORS).get(name)
    if process is None:
        raise KeyError(f"no processor registered for {name!r}")
    decoded = decode(read_stream(spark, cfg), schema, tuple(cfg.get("required", ())))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            process(good_records(batch)).write.mode("overwrite").parquet(f"{sink}/records/batch={batch_id}")
            failed_records(batch).write.mode("overwrite").parquet(f"{sink}/errors/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{cfg.get('checkpoint_interval', CHECKPOINT_SECONDS)} seconds")
    return writer.start()


def run_profiled(df: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the profile of every batch: a row of mergeable sketches per column, in a folder that a retry overwrites.

    :func:`merged_sketches` has the profile of all batches so far. A distinct count of a batch can't be added to
    that of another; their sketches can be merged.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sketch_columns(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime=f"{CHECKPOINT_SECONDS} seconds")).start()


def merged_sketches(spark: SparkSession, sink: str) -> DataFrame:
    """The sketches of all batches that :func:`run_profiled` has written, see ``sketch_report``."""
    return merge_sketches(spark.read.parquet(sink).drop("batch"))


def run_counted(df: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the values of every batch with their counts, for exact profiles: a batch's distinct values, not its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        frequencies(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime=f"{CHECKPOINT_SECONDS} seconds")).start()


def merged_counts(spark: SparkSession, sink: str) -> DataFrame:
    """``column, row_count, null_count, unique_count`` of all rows that :func:`run_counted` has seen, exactly."""
    values = spark.read.parquet(sink).groupBy("column", "key").agg(F.sum("rows").alias("rows"))
    return values.groupBy("column").agg(
        F.sum("rows").alias("row_count"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("rows"))), F.lit(0)).alias("null_count"),
        F.count("key").alias("unique_count"))


def run_totals(df: DataFrame, sink: str, checkpoint: str, available_now: bool = False,
               keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Keep the results of a streaming aggregation, one parquet folder per batch below ``sink``.

    With the aggregation's ``keys`` a batch writes only the rows that it changed, and a
    watermark drops the state of windows that are over; :func:`newest_state` takes the last row of each key, and
    :func:`compact_states` merges the folders now and then. Without keys every batch
    writes all rows, for aggregations of bounded size such as one row of counts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/state={batch_id}")

    writer = df.writeStream.outputMode("update" if keys else "complete").foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime=f"{CHECKPOINT_SECONDS} seconds")).start()


def _merged(spark: SparkSession, sink: str) -> DataFrame | None:
    """What :func:`compact_states` left, if it ever ran."""
    try:
        return spark.read.parquet(f"{sink}-merged")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_state(spark: SparkSession, sink: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The results that :func:`run_totals` has written so far, with the same ``keys``."""
    states = spark.read.parquet(sink)
    if not keys:
        last = states.agg(F.max("state")).scalar()
        return states.where(F.col("state") == last).drop("state")
    merged = _merged(spark, sink)
    if merged is not None:
        upto = merged.agg(F.max("upto")).scalar()
        kept = merged.where(F.col("upto") == upto).withColumn("state", F.col("upto")).drop("upto")
        states = states.where(F.col("state") > upto).unionByName(kept.select(*states.columns))
    rest = [c for c in states.columns if c not in (*keys, "state")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "state").alias("row")).select(*keys, "row.*")


def compact_states(spark: SparkSession, sink: str, keys: tuple[str, ...]) -> None:
    """Merge all batches so far into one folder beside ``sink``, which later reads start from.

    Batch folders up to the merged one are no longer read and may be removed. A compaction that
    fails or runs twice leaves a folder that is overwritten.
    """
    upto = spark.read.parquet(sink).agg(F.max("state")).first()[0]
    newest_state(spark, sink, keys).write.mode("overwrite").parquet(f"{sink}-merged/upto={upto}")


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON messages with an optional key."""
    cells = [F.to_json(F.struct("*"), JSON_TIMES).alias("value")]
    if key:
        cells.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cells)


def publish(df: DataFrame, cfg: dict, checkpoint: str | None = None):
    """Send rows as JSON to a topic, or to a text folder (``type: files``).

    A streaming frame needs a checkpoint and returns its query.
    """
    messages = to_messages(df, cfg.get("key"))
    if cfg["type"] == "files":
        fmt, options = "text", {"path": cfg["path"]}
        messages = messages.select("value")
    else:
        built = source_spec(cfg).options(cfg, None)
        fmt = "kafka"
        options = {k: v for k, v in built.items() if k.startswith("kafka.")}
        options["topic"] = built["subscribe"]
    if df.isStreaming:
        if not checkpoint:
            raise ValueError("a streaming publish needs a checkpoint folder")
        return (messages.writeStream.format(fmt).options(**options)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    messages.write.format(fmt).mode("append").options(**options).save()
    return None
