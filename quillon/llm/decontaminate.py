"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Shingles of the benchmark that are broadcast at once; a larger benchmark takes several passes over the documents.
BLOCK_SHINGLES = 1_000_000
#: Windows whose prefixes may be broadcast (about 200 bytes each).
BROADCAST_WINDOWS = 200_000
#: Documents with hits whose keys may be broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_key"]


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case, and only those; null has none."""
    text = F.coalesce(text, F.lit(""))
    # in a text of ASCII alone lower() changes A-Z alone, and is much faster than translate()
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, window`` (array of words): the windows of ``size`` words, or all words of a shorter item."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last),
                                                         lambda i: F.slice("words", i + 1, size))).alias("window"))


def _join(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def token_rows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``doc_id, text_key, pos, n, token, hash``: the shingles of ``sizes`` words of every document by position, and one row
    at position -1 for the document itself, with an empty token."""
    text = F.coalesce("text", F.lit(""))

    def shingles(words: Column, n: int) -> Column:
        def one(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.size(words).alias("n"),
                            F.xxhash64(F.lit(n), *[words[i + j] for j in range(n)]).alias("hash"),
                            *[(words[i + j] if j < n else F.lit(None).cast("string")).alias(f"w{j}")
                              for j in range(SHINGLE_WORDS)])
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), one)).otherwise(
            F.array().cast(KIND))

    def rows(words: Column) -> Column:
        own = F.array(F.struct(F.lit(-1).alias("pos"), F.size(words).alias("n"), F.lit(0).cast("long").alias("hash"),
                               F.lit("").alias("w0"), *[F.lit(None).cast("string").alias(f"w{j}")
                                                        for j in range(1, SHINGLE_WORDS)]).cast(ROW))
        return F.concat(own, *[shingles(words, n) for n in sizes])

    # words are split once: as the only element of an array that transform() hands on
    found = F.flatten(F.transform(F.array(words_of(F.col("text"))), rows))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.inline(found))


ROW = "struct<pos:int,n:int,hash:bigint," + ",".join(f"w{j}:string" for j in range(SHINGLE_WORDS)) + ">"
KIND = f"array<{ROW}>"


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document (``doc_id, text_key, n_words, copies``), and every place of a distinct window in one
    (``doc_id, text_key, start, window, length``).

    Windows become sets of shingles with their offsets, ordered by rarity in the documents. A window that a document
    contains shares all its shingles with it, so its prefix is one token, the rarest. Documents that have the token
    are candidates where the window fits: it begins at the token's position less its offset, not before the first
    word, and ends by the last one. A candidate is verified by the shingles that tile the window, word by word.
    """
    size = F.least(F.size("window"), F.lit(SHINGLE_WORDS))
    distinct = written(windows.select("window").distinct(), "windows")
    tokens = distinct.select("window", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("window") - size), lambda i: F.struct(
            size.alias("size"), _join(F.col("window"), i, size).alias("token")))).alias("offset", "t")).select(
        "window", "offset", "t.size", "t.token")
    tokens = written(tokens, "window-tokens")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # 1 to 3
    named = F.split("token", " ")
    hashed = F.lit(0).cast("long")
    for n in sizes:
        hashed = F.when(F.col("size") == n, F.xxhash64(F.lit(n), *[named[j] for j in range(n)])).otherwise(hashed)
    vocabulary = tokens.select("token", "size").distinct().select("token", hashed.alias("hash"))
    blocks = max(1, -(-vocabulary.count() // BLOCK_SHINGLES))
    token = F.concat_ws(" ", *[f"w{j}" for j in range(SHINGLE_WORDS)])
    rows = token_rows(docs, sizes)
    passes = []
    for block in range(blocks):
        part = vocabulary.where(F.pmod("hash", F.lit(blocks)) == block).select("hash", F.col("token").alias("_token"))
        if block == 0:
            part = part.union(docs.sparkSession.sql("select 0L as hash, '' as _token"))
        passes.append(rows.join(F.broadcast(part), "hash").where(token == F.col("_token")).select(
            *KEY, "pos", "n", F.col("_token").alias("token")))
    found = written(reduce(DataFrame.union, passes), "tokens")

    seen = found.where("pos >= 0").groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(seen, "token", "left").groupBy("window").agg(
        F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("prefix"),
        F.min(F.coalesce("n", F.lit(0))).alias("rarest")).where("rarest > 0")
    prefixes = written(ranked.select(F.col("prefix.token").alias("token"), F.col("prefix.offset").alias("offset"),
                                     "window"), "prefixes")
    if prefixes.count() <= BROADCAST_WINDOWS:
        prefixes = F.broadcast(prefixes)
    placed = found.where("pos >= 0").join(prefixes, "token")
    start = F.col("pos") - F.col("offset")
    candidates = placed.where((start >= 0) & (start + F.size("window") <= F.col("n"))).select(
        *KEY, start.alias("start"), "window").distinct()
    # shingles at every third offset and at the last cover the window
    tiles = F.array_distinct(F.concat(F.sequence(F.lit(0), F.size("window") - size, F.lit(SHINGLE_WORDS)),
                                      F.array(F.size("window") - size)))
    wanted = candidates.withColumn("of", F.size(tiles)).select("*", F.explode(tiles).alias("at")).select(
        *KEY, "start", "window", "of", (F.col("start") + F.col("at")).alias("pos"),
        _join(F.col("window"), F.col("at"), size).alias("token"))
    places = found.where("pos >= 0").select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "pos", "token")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY] + [F.col(c) == F.col(f"_{c}") for c in ("pos", "token")]
    checked = wanted.join(places, same).groupBy(*KEY, "start", "window").agg(
        F.count("*").alias("got"), F.first("of").alias("of")).where("got = of")
    every = found.where("pos < 0").groupBy(*KEY).agg(F.max("n").cast("long").alias("n_words"),
                                                     F.count("*").cast("int").alias("copies"))
    return every, written(checked.select(*KEY, "start", "window", F.size("window").alias("length")), "occurrences")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    ``text_key`` tells rows of a repeated doc_id apart; rows equal in both give equal results, one each. A text that is
    null or has no words has no hits; items without words have no windows; an item without an id makes hits but counts
    as no item, and rows of one item_id are one item. An empty benchmark leaves every row clean, and no documents give
    no rows.
    """
    windows = written(windows_of(benchmark, size), "item-windows")
    every, places = occurrences(docs, windows)
    # at most as many places as the document has words
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hits = places.groupBy(*KEY).agg(F.collect_set(F.struct("start", "length")).alias("spans")).select(
        *[F.col(c).alias(f"_{c}") for c in KEY], F.size(F.array_distinct(hit)).cast("long").alias("n_hit"))
    members = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    items = places.select(*KEY, "window").distinct().join(members, "window").groupBy(*KEY).agg(
        F.sort_array(F.collect_set("item")).alias("items")).select(*[F.col(c).alias(f"_{c}") for c in KEY], "items")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}._doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}._text_key"))

    items_of = F.coalesce("items", F.array().cast("array<string>"))
    both = every.alias("e").join(hits.alias("h"), same("e", "h"), "left").join(items.alias("i"), same("e", "i"), "left")
    one = both.select("e.doc_id", "e.text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(items_of).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "copies")
    return one.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_i")).drop("_i", "copies")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    dirty = contamination(docs, benchmark, size).where("contaminated").select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct()
    dirty = written(dirty, "dirty")
    if dirty.count() <= BROADCAST_ROWS:
        dirty = F.broadcast(dirty)
    key = F.xxhash64(F.coalesce("d.text", F.lit("")))
    return docs.alias("d").join(dirty.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h._doc_id"))
                                & (key == F.col("h._text_key")), "left_anti")
