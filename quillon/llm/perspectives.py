"""Chat formatting from every speaker's side: that speaker is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written

SYSTEM = "system"
END = "<|end|>"
#: Characters of a text that decide into which block of tied turns it goes.
TIE_CHARS = 64


def escaped(text: Column) -> Column:
    """The text without marks of the format: each ``<|`` gets a backslash, and one more if it has some, so that
    ``unescaped`` gives the text back. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column | str) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def perspectives(conversations: DataFrame, system: str = SYSTEM, parts: int | None = None) -> DataFrame:
    """A row per turn and perspective: ``conv_id, perspective, seq, turn, role, segment, start, end, mask_start, mask_end``.

    Every speaker of a conversation but ``system`` is a perspective. The segments of one, by ``seq`` (from 0), make the
    rendered dialogue: its own turns as ``<|assistant|>``, turns of others as ``<|user name=...|>`` (names URL-encoded), of
    ``system`` as ``<|system|>``. ``start, end`` are the segment's code points in the dialogue; ``mask_start, mask_end`` those
    to be learned, the text and the end mark of the perspective's turns, null elsewhere.

    Turns are in the order of ``turn`` (null first), then speaker, then text, so ties have one order and equal rows are turns of
    their own. A null speaker is a nameless user and no perspective; null text is empty; rows with a null
    conv_id are one conversation; one without speakers, like an empty table, gives no rows. Other columns are ignored.

    A conversation is never gathered: all turns are sorted into ranges (``parts``, by default as many as the cluster shuffles
    into), and places are sums within a range plus the sums of the ranges before. A very long conversation crosses many ranges, also
    if its turns have no numbers or the same one.
    """
    rows = ranged(rendered(conversations, system), parts)
    return placed(rows)


def rendered(conversations: DataFrame, system: str = SYSTEM) -> DataFrame:
    """``conv_id, perspective, turn, role, text, own, segment, n``: the turns from every side, without their places."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.where(F.col("role").isNotNull() & (F.col("role") != system)).groupBy("conv_id").agg(
        F.sort_array(F.collect_set("role")).alias("speakers"))
    t, s = turns.alias("t"), speakers.alias("s")
    each = t.join(s, F.col("t.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "t.*", F.explode("speakers").alias("perspective"))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    head = F.when(F.col("role") == system, F.lit("<|system|>")).when(own, F.lit("<|assistant|>")).when(
        F.col("role").isNull(), F.lit("<|user|>")).otherwise(F.concat(F.lit("<|user name="), F.url_encode("role"), F.lit("|>")))
    rows = each.select("conv_id", "perspective", "turn", "role", "text", own.alias("own"),
                       F.concat(head, F.lit("\n"), escaped(F.col("text")), F.lit(f"{END}\n")).alias("segment"))
    return rows.withColumn("n", F.length("segment").cast("long"))


def ranged(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The turns with ``block``, the number of the range of the whole order that they are in. Written, so that rows keep their range."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "perspective", "turn", "role")]
    order.append(F.substring("text", 1, TIE_CHARS).asc())
    cut = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return written(cut.withColumn("block", F.spark_partition_id()), "turns")


def placed(rows: DataFrame) -> DataFrame:
    """The turns of ``ranged`` with their places."""
    keys = ["conv_id", "perspective", "block"]
    order = "PARTITION BY conv_id, perspective, block ORDER BY turn, role, text"
    inside = rows.withColumns({
        "i": F.expr(f"row_number() OVER ({order}) - 1L"),
        "at": F.expr(f"coalesce(sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")})
    before = "OVER (PARTITION BY conv_id, perspective ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.expr(f"coalesce(sum(rows) {before}, 0L)").alias("rows_before"),
        F.expr(f"coalesce(sum(chars) {before}, 0L)").alias("chars_before"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    both = inside.join(blocks, same & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block")))
    start = F.col("chars_before") + F.col("at")
    end = start + F.col("n")
    return both.select("conv_id", "perspective", (F.col("rows_before") + F.col("i")).alias("seq"), "turn", "role", "segment",
                       start.alias("start"), end.alias("end"),
                       F.when(F.col("own"), start + len("<|assistant|>\n")).alias("mask_start"),
                       F.when(F.col("own"), end - 1).alias("mask_end"))
