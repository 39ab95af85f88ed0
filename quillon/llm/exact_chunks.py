"""Exact deduplication by recipes: texts become ordered lists of verified chunk identifiers, and only lists are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written

#: Code points of a chunk. Past the first, a chunk ends at the next line end or mark of punctuation; the second ends
#: a chunk that finds none.
MIN_CHUNK = 512
MAX_CHUNK = 8192
#: Groups with at least one row in so many may be broadcast: there can't be more than this number of them.
HOT_SHARE = 1000
#: Identifiers (eight bytes each) that a broadcast of hot groups may hold.
BROADCAST_IDS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A to Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; joined, they are the text. Empty text has none.

    Where a chunk ends depends on the characters there, not on the position in the text, so texts that differ in one
    place have the same chunks again soon after it.
    """
    pattern = rf"(?s).{{{least},{most - 1}}}?[\n.!?;:,。，、！？；]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _name(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, name: Callable[[Column], Column] = _name, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """``row, doc_id, ids, chunks, text_sha256`` of every row: the names of its chunks in order, and the chunks. Written, so
    that row numbers stay and every later step reads only the columns that it needs."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    cut = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", chunks_of(F.col("text"), least, most).alias("chunks"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return written(cut.withColumn("ids", F.transform("chunks", name)), "recipes")


def clashes(recipe: DataFrame) -> DataFrame:
    """``id, chunk, variant`` of the chunks that share their name with another chunk: none, as a rule.

    Chunks of one name are compared whole. Equal ones are merged in every task before they are shuffled, so that a
    chunk moves once per task and not once per document.
    """
    each = recipe.select(F.explode(F.arrays_zip("ids", "chunks")).alias("c")).select(
        F.col("c.ids").alias("id"), F.col("c.chunks").alias("chunk"))
    distinct = each.distinct()
    double = written(distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "clashes")
    if double.isEmpty():
        return distinct.limit(0).withColumn("variant", F.lit(0))
    return written(distinct.join(double, "id").withColumn("variant", F.expr(
        "row_number() OVER (PARTITION BY id ORDER BY chunk) - 1")), "variants")


def verified(recipe: DataFrame) -> DataFrame:
    """``row, doc_id, ids, marks, text_sha256``: with ``marks``, the places and variants of chunks that are not the first of their
    name, equal lists mean equal chunks. Nearly always there is no such chunk, and ``marks`` is empty."""
    variants = clashes(recipe)
    plain = recipe.select("row", "doc_id", "ids", "text_sha256")
    none = F.array().cast("array<struct<place:int,variant:int>>")
    if variants.isEmpty():
        return plain.withColumn("marks", none)
    each = recipe.select("row", F.posexplode(F.arrays_zip("ids", "chunks")).alias("place", "c")).select(
        "row", "place", F.col("c.ids").alias("id"), F.col("c.chunks").alias("chunk"))
    marks = each.join(variants.where("variant > 0"), ["id", "chunk"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", "variant"))).alias("found"))
    return plain.join(marks, "row", "left").withColumn("marks", F.coalesce("found", none)).drop("found")


def duplicates(docs: DataFrame, name: Callable[[Column], Column] = _name, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Rows are equal if their texts are, after A to Z are lower-cased; then they have the same recipe. Of equal rows the
    one with the largest doc_id stays (null is the smallest; of rows that repeat the largest id one stays), and
    ``keep_id`` is its id. Null text is empty, and empty texts are equal. Other columns are ignored; an empty table gives no rows.

    Texts are read once. What is shuffled is each distinct chunk of a task, for the comparison, and recipes of eight bytes a chunk.
    Groups are counted before the shuffle; the rows of the few groups that hold a thousandth of the table or more meet
    their group by a broadcast of checked size, so that a very large group is not one task.
    """
    rows = verified(recipes(docs, name, least, most))
    groups = rows.groupBy("ids", "marks").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays"))
    groups = written(groups.where("group_size > 1"), "groups")
    hot = groups.where(F.col("group_size") >= rows.count() / HOT_SHARE)
    size = hot.agg(F.coalesce(F.sum(F.size("ids") + 2 * F.size("marks") + 4), F.lit(0))).first()[0]
    keys = ["ids", "marks"]
    if size <= BROADCAST_IDS:
        found = rows.join(F.broadcast(hot), keys, "left")
        rest = groups.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
        other = found.where("group_size is null").drop("group_size", "stays").join(rest, keys, "left")
        found = found.where("group_size is not null").unionByName(other)
    else:
        found = rows.join(groups, keys, "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("stays.row"))).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat an id and its text one stays."""
    rows = written(duplicates(docs), "duplicates")
    key = F.sha2(normalised(F.col("d.text")).cast("binary"), 256)

    def pairs(found: DataFrame) -> DataFrame:
        return found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct().alias("k")

    def with_pairs(found: DataFrame, kind: str) -> DataFrame:
        return docs.alias("d").join(pairs(found), F.col("d.doc_id").eqNullSafe(F.col("k._id")) & (key == F.col("k._sha")), kind)

    twice = rows.where("not kept").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = rows.where("kept")
    if twice.isEmpty():
        return with_pairs(kept, "left_semi")
    once = kept.join(pairs(twice), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left_anti")
    repeated = with_pairs(twice, "inner").dropDuplicates(["_id", "_sha"]).drop("_id", "_sha")
    return with_pairs(once, "left_semi").unionByName(repeated)
