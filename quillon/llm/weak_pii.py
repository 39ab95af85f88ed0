"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier learned from that decides."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spans import count_kind, cut, let, meets_any, named, segments, with_spans
from quillon.llm.tables import written

#: In the order in which spans of one start are listed. The first four are always reported.
KINDS = ["email", "ip", "card", "phone", "name", "address", "national_id", "local_phone", "iban"]
BASE = 4
CONTEXT = 40
STEPS = 50
#: Observations that stand for what is believed of a labeler before any span is seen, and how reliable it then is.
PRIOR_WEIGHT, PRIOR_RELIABILITY = 10.0, 0.8

#: A run is only begun at its first character or where the last match ended; the quantifiers give nothing back.
#: Neither changes what is matched; both keep long runs linear.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\b\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
    r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court)\b",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9+.(-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
]

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|se|ca|au|jp|cn|in|br"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|60|61|62|63|64|65|66|81|82|84|86|90|91"
FIRST_NAMES = ("James|Mary|John|Anna|Robert|Maria|Michael|Linda|David|Laura|William|Emma|Thomas|Sarah|Peter|Julia|Paul|Marie|"
               "Hans|Karl|Jean|Pierre|Juan|Carlos|Luis|Carmen|Sofia|Elena|Martin|Daniel")
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE"
CUES = ["mail|contact|write|courriel|correo", r"\bip\b|address|host|client|login", "card|visa|credit|karte|carte|tarjeta",
        "phone|call|tel|mobile|fax|contact", "name|dear|contact|signed|patient|from", "address|live|resid|home|street|ship",
        "ssn|social|security|national|insurance", "phone|call|tel|mobile|fax|contact", "iban|account|bank|konto|compte|cuenta"]
REFUSALS = "version|release|example|sample|serial|isbn|order|invoice|ticket|build|chapter|figure|model|part no"
KEY = ["doc_id", "text_key"]
VOTES = 5
FEATURES = 7


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def passes(span: Column) -> Column:
    """Whether a base match stands: parts of an address up to 255, digits of a card and a phone."""
    m, kind = span["match"], span["kind"]
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits(m))
    card = F.when(n.between(12, 19), let(digits(m), luhn)).otherwise(False)
    return F.when(kind == 1, small).when(kind == 2, card).when(kind == 3, n.between(9, 15)).otherwise(True)


def _by_kind(kind: Column, values: list[Column]) -> Column:
    out = F.lit(0)
    for k, value in enumerate(values):
        out = F.when(kind == k, value).otherwise(out)
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, -1)).otherwise(0)


def votes(span: Column, before: Column, left: Column, right: Column) -> Column:
    """The votes of the labelers on a span: 1 personal, -1 not, 0 no opinion.

    In order: its format, a gazetteer, cue words before it, words before it that speak against, its two neighbours.
    """
    m, kind = span["match"], span["kind"]
    n = F.length(digits(m))
    ok = [m.rlike(r"\.[A-Za-z]{2,24}$"), ~m.rlike(r"^(?:0|127|255)\.|(?:^|\.)0[0-9]"), m.rlike("^[3-6]"), n >= 10,
          m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), F.length(m) >= 12, ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
          m.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), F.length(F.regexp_replace(m, " ", "")).between(15, 34)]
    form = _by_kind(kind, [_vote(o, ~o) for o in ok])
    listed = _by_kind(kind, [
        _vote(m.rlike(rf"\.(?i:{TOP_DOMAINS})$")), _vote(F.lit(False), m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")),
        _vote(m.rlike("^(?:4|5[1-5]|3[47]|6011|65)")), _vote(m.rlike(rf"^\+(?:{CALLING_CODES})(?![0-9]{{14}})"), ~m.rlike(
            rf"^\+(?:{CALLING_CODES})")), _vote(m.rlike(rf"\b(?:{FIRST_NAMES})\b")), _vote(m.rlike("Street|Avenue|Road|Lane")),
        F.lit(0), F.lit(0), _vote(m.rlike(f"^(?:{COUNTRIES})"), ~m.rlike(f"^(?:{COUNTRIES})"))])
    cue = _by_kind(kind, [_vote(before.rlike(f"(?i){c}")) for c in CUES])
    against = _vote(F.lit(False), before.rlike(f"(?i)(?:{REFUSALS})"))
    glued = left.rlike("[A-Za-z0-9_]") | right.rlike("[A-Za-z0-9_]")
    return F.array(form, listed, cue, against, _vote(~glued, glued))


def features(span: Column, left: Column, right: Column) -> Column:
    """Small whole numbers that the classifier sees: length, digits, capitals, separators, both neighbours, variety."""
    m = span["match"]
    size = F.length(m)

    def share(what: str) -> Column:
        return F.floor(4 * F.length(F.regexp_replace(m, f"[^{what}]", "")) / size).cast("int")

    def near(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike("[.,;:!?]"), 3).otherwise(4)

    variety = F.floor(4 * F.size(F.array_distinct(F.split(m, ""))) / size).cast("int")
    return F.array(F.least(F.floor(F.log2(size)).cast("int"), F.lit(7)), share("0-9"), share("A-Z"), share(r"\x20.()-"),
                   near(left), near(right), variety)


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, spans`` of every row: base spans, and all candidates with votes and features."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = with_spans(rows, "text", {f"s{k}": (pattern, k) for k, pattern in enumerate(PATTERNS)})
    base = [f"s{k}" for k in range(BASE)]
    rows = rows.withColumns({c: F.filter(c, passes) for c in base})
    weak = F.filter(F.concat(*[f"s{k}" for k in range(BASE, len(KINDS))]), lambda w: ~reduce(or_, [meets_any(F.col(c), w) for c in base]))
    rows = rows.select(*KEY, "text", F.concat(*base).alias("base"), weak.alias("weak")).withColumn("spans", F.concat("base", "weak"))
    rows = rows.withColumn("pieces", F.when(F.size("spans") > 0, segments(F.col("text"))))

    def judge(span: Column, pieces: Column) -> Column:
        begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
        around = F.struct(cut(pieces, begin, span["start"] - begin).alias("before"),
                          cut(pieces, span["end"], F.lit(1)).alias("right"))

        def seen(a: Column) -> Column:
            left = F.right(a["before"], F.lit(1))
            return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                            votes(span, a["before"], left, a["right"]).alias("votes"),
                            features(span, left, a["right"]).alias("features"))
        return let(around, seen)

    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*KEY, plain.alias("base"), F.transform("spans", lambda s: judge(s, F.col("pieces"))).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability that a span is personal for every (kind, votes), by expectation-maximisation.

    ``patterns`` has each kind and combination of votes with its count, at most 3^5 combinations a kind. The unknowns
    are, per kind, the share of personal spans and for every labeler how often it says what of personal and other
    spans; beliefs about labelers stand in for spans while there are few.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        r, w = PRIOR_RELIABILITY, PRIOR_WEIGHT
        believed = [{y: {v: w * (1 / 3 if v == 0 else (2 / 3) * (r if v == y else 1 - r)) for v in (-1, 0, 1)}
                     for y in (1, -1)} for _ in range(VOTES)]
        said = [{y: {v: b[y][v] / w for v in b[y]} for y in b} for b in believed]
        share = 0.5
        posterior = {}
        for _ in range(STEPS):
            for v, _ in rows:
                yes = math.log(share) + sum(math.log(said[i][1][x]) for i, x in enumerate(v))
                no = math.log(1 - share) + sum(math.log(said[i][-1][x]) for i, x in enumerate(v))
                posterior[v] = 1 / (1 + math.exp(min(700.0, no - yes)))
            total = sum(n for _, n in rows)
            share = (1 + sum(n * posterior[v] for v, n in rows)) / (2 + total)
            for i in range(VOTES):
                for y in (1, -1):
                    sums = dict(believed[i][y])
                    for v, n in rows:
                        sums[v[i]] += n * (posterior[v] if y == 1 else 1 - posterior[v])
                    whole = sum(sums.values())
                    said[i][y] = {v: s / whole for v, s in sums.items()}
        out |= {(kind, v): posterior[v] for v, _ in rows}
    return out


def _lookup(table: dict[str, float], key: Column) -> Column:
    """A value from a table of bounded size that stands in the plan; 0 for what is not in it."""
    if not table:
        return F.lit(0.0)
    entries = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.coalesce(F.create_map(*entries)[key], F.lit(0.0))


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The span classifier: log odds of every kind, and of every feature value of a kind.

    Naive Bayes on the probabilities of ``reliabilities``. Both collects are counts by bounded keys: votes of a kind,
    and feature values of a kind, whatever the number of spans.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    counted = spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    posterior = reliabilities([(r["kind"], tuple(r["votes"]), r["count"]) for r in counted])
    table = {f"{k}:{','.join(map(str, v))}": p for (k, v), p in posterior.items()}
    soft = spans.withColumn("p", _lookup(table, F.concat(F.col("kind"), F.lit(":"), F.array_join(
        F.col("votes").cast("array<string>"), ","))))
    by_kind = soft.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    by_value = soft.select("kind", "p", F.posexplode("features").alias("i", "v")).groupBy("kind", "i", "v").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    whole = {r["kind"]: (r["yes"], r["no"]) for r in by_kind}
    prior = {str(k): math.log((y + 1) / (n + 1)) for k, (y, n) in whole.items()}
    odds = {f"{r['kind']}:{r['i']}:{r['v']}": math.log((r["yes"] + 1) / (whole[r["kind"]][0] + 8))
            - math.log((r["no"] + 1) / (whole[r["kind"]][1] + 8)) for r in by_value}
    return prior, odds


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row of ``docs``.

    Base spans always stand. Names after titles, street addresses, national numbers, local phone numbers and account
    numbers are reported where the classifier, trained on all spans of ``docs``, finds personal data likelier than not; those
    that overlap a base span are not looked at. Null is the empty text, without spans; equal rows get equal results; an
    empty table gives none and trains nothing.
    """
    found = written(parts(docs), "pii-parts")
    prior, odds = train(found)

    def personal(span: Column) -> Column:
        kind = span["kind"].cast("string")
        terms = F.transform(span["features"], lambda v, i: _lookup(odds, F.concat_ws(":", kind, i, v)))
        return (span["kind"] >= BASE) & (F.aggregate(terms, _lookup(prior, kind), lambda t, x: t + x) >= 0)

    weak = F.transform(F.filter("spans", personal), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*KEY, *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
                        F.sha2(named(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
                        named(F.concat("base", weak), KINDS).alias("spans"))
