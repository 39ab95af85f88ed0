"""Secret scans: strong patterns alone, weak parts of a credential only beside a complementary part."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spans import count_kind, cut, let, meets_any, named, running, segments, with_spans
from quillon.llm.tables import written

#: In the order in which spans of one start are listed. The first three are reported by themselves.
KINDS = ["assign", "access", "hex", "id", "endpoint", "key"]
BASE = 3
SECRETS = (0, 2, 5)  # a value that must be kept secret; the others say whose it is or where it is used
#: Code points between two parts that belong together, at most.
SCOPE = 200
BIN = 256
#: Spans of documents that may be broadcast; beyond, the texts are shuffled.
BROADCAST_BYTES = 32 << 20

PATTERNS = [
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]{32,}",
    r"""(?i:access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    r"""(?i:https?|ftps?|ssh|s3|jdbc:[a-z]{2,12}|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""",
    r"[A-Za-z0-9+/_=-]{20,}",
]
KEY = ["doc_id", "text_key"]


def strong(span: Column) -> Column:
    """Whether a base match passes: eight characters of value, sixteen of access key; hex has its 32 by the pattern."""
    value = F.length(F.regexp_extract(span["match"], PATTERNS[0], 1))
    return F.when(span["kind"] == 0, value >= 8).when(span["kind"] == 1, F.length(span["match"]) >= 16).otherwise(True)


def random_looking(span: Column) -> Column:
    """A bare token with both cases, a digit and ten different characters."""
    m = span["match"]
    return (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
            & (F.size(F.array_distinct(F.split(m, ""))) >= 10))


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, weak`` of every row: arrays of spans without their text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = with_spans(rows, "text", {f"s{k}": (pattern, k) for k, pattern in enumerate(PATTERNS)})

    def apart(span: Column, kinds: range) -> Column:
        return ~reduce(or_, [meets_any(F.col(f"s{k}"), span) for k in kinds])

    base, links = range(BASE), range(BASE, len(KINDS) - 1)
    rows = rows.withColumns({f"s{k}": F.filter(f"s{k}", strong) for k in base})
    rows = rows.withColumn("s5", F.filter("s5", lambda k: random_looking(k) & apart(k, links)))
    weak = F.filter(F.concat("s3", "s4", "s5"), lambda w: apart(w, base))
    bare = "array<struct<kind:int,start:int,end:int>>"
    return rows.select(*KEY, _bare(F.concat(*[f"s{k}" for k in base])).cast(bare).alias("base"), _bare(weak).cast(bare).alias("weak"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def linked(found: DataFrame) -> DataFrame:
    """``doc_id, text_key, weak`` with the weak spans that lie in the scope of a complementary part.

    An interval join: the scope of a part that names an identity or a place reaches ``SCOPE`` code points beyond it;
    secrets that meet it are its complement, and it is theirs. Both sides go to bins of ``BIN`` code points and meet
    there; a bin holds few spans, as spans of a kind don't overlap. Semi-joins report each span once and make no pairs.
    """
    def secret(s: Column) -> Column:
        return s["kind"].isin(*SECRETS)

    # a complement needs both sorts in the document and something weak to report
    rows = found.where((F.size("weak") > 0) & F.exists(F.concat("base", "weak"), secret)
                       & F.exists(F.concat("base", "weak"), lambda s: ~secret(s)))
    spans = rows.select(*KEY, F.explode(F.concat("base", "weak")).alias("s")).select(*KEY, "s.*")
    spans = written(spans.distinct(), "credential-parts")

    def binned(part: DataFrame, reach: int) -> DataFrame:
        low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
        bins = F.sequence(F.floor(low / BIN), F.floor(high / BIN))
        return part.withColumns({"low": low, "high": high, "bin": F.explode(bins)})

    secrets = binned(spans.where(F.col("kind").isin(*SECRETS)), 0)
    owners = binned(spans.where(~F.col("kind").isin(*SECRETS)), SCOPE)

    def meets(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = a.where(F.col("kind") >= BASE).alias("a"), b.alias("b")
        return left.join(right, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
                         & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.bin") == F.col("b.bin"))
                         & (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high")), "left_semi")

    both = meets(secrets, owners).union(meets(owners, secrets))
    return both.groupBy(*KEY).agg(F.collect_set(F.struct("kind", "start", "end")).alias("weak"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``.

    Base spans always stand: assignments of a value, access identifiers, long hexadecimal runs. Identifiers, endpoints and
    bare random tokens are reported only within ``SCOPE`` code points of their complement: a secret for identifiers
    and endpoints, an identifier or endpoint for a token. Weak spans that overlap a base span are not looked at.
    Null is the empty text, without spans; equal rows get equal results; an empty table gives none.
    """
    found = written(parts(docs), "secret-parts")
    more = linked(found).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"),
                                F.col("weak").alias("_weak"))
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")),
                      "left")
    every = F.when(F.col("_weak").isNull(), F.col("base")).otherwise(F.concat("base", "_weak"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return both.select(*KEY, *counts, F.sha2(named(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
                       named(every, KINDS).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; no row goes. Touching and overlapping spans
    become one mark. A null text stays null."""
    found = scan(docs).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"),
                              F.col("spans").alias("_spans")).where("_spans <> ''").distinct()
    found = written(found, "secret-spans")
    if (found.agg(F.sum(F.length("_spans") + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    text = F.coalesce("d.text", F.lit(""))
    both = docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f._doc_id"))
                                & (F.xxhash64(text) == F.col("f._text_key")), "left")
    spans = F.transform(F.split("f._spans", ","), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")))

    # spans come by their starts; what lies between one and the furthest end before it stays
    def pieces(of: Column) -> Column:
        ends = running(F.transform(of["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        marks = F.zip_with(of["spans"], ends, lambda s, at: F.when((at > 0) & (s["start"] <= at), F.lit("")).otherwise(
            F.concat(cut(of["text"], at, F.greatest(s["start"] - at, F.lit(0))), F.lit(mark))))
        last = F.array_max(F.transform(of["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(marks, ""), cut(of["text"], last, F.length(text) - last))

    marked = let(F.struct(spans.alias("spans"), segments(text).alias("text")), pieces)
    return both.select(*[F.when(F.col("f._spans").isNull(), F.col("d.text")).otherwise(marked).alias("text")
                         if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
