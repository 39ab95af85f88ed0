"""Spans of regular expressions in a text, in DataFrame functions alone. Positions are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int,match:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


#: Elements that are at least summed one by one; see ``running``.
BLOCK = 64
#: Code points of a segment, see ``segments``.
SEGMENT = 4096


def _running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """What the elements before each one come to, one by one. An element copies those before it, so only for short arrays."""
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                       lambda s: s["out"])


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: int = 0) -> Column:
    """For each of ``values`` (whole numbers) what the elements before it come to by the associative ``op``.

    Blocks of about the square root of the size are dealt with one by one, and so are their totals: an element copies a
    block's references at most, never those of the whole array.
    """
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(values))).cast("int"))

    def spread(cut_up: Column) -> Column:
        parts = cut_up["parts"]
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), op))
        return F.flatten(F.zip_with(parts, _running(totals, op, zero), lambda p, before: F.transform(
            _running(p, op, zero), lambda x: op(before, x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
    return F.when(F.size(values) <= BLOCK, _running(values, op, zero)).otherwise(let(F.struct(blocks.alias("parts")), spread))


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with a column for each name of ``patterns``: all matches of its pattern (leftmost, not overlapping, never
    empty) as an array of ``SPAN`` of its kind, by their starts. Names with an underscore before them are used inside.

    The text between the matches, from ``split``, and the matches themselves alternate, so running sums of their lengths are
    the positions; texts without a match, nearly all, are searched once.
    """
    names = list(patterns)
    df = df.withColumns({f"_match_{n}": F.regexp_extract_all(F.col(text), F.lit(patterns[n][0]), F.lit(0)) for n in names})
    # the last gap follows the last match
    df = df.withColumns({f"_gaps_{n}": F.when(F.size(f"_match_{n}") > 0, F.transform(F.slice(
        F.split(F.col(text), patterns[n][0], -1), F.lit(1), F.size(f"_match_{n}")), F.length)) for n in names})
    df = df.withColumns({f"_steps_{n}": F.zip_with(f"_gaps_{n}", f"_match_{n}", lambda gap, match: gap + F.length(match)) for n in names})
    df = df.withColumns({f"_at_{n}": F.zip_with(running(F.col(f"_steps_{n}")), f"_gaps_{n}", lambda a, b: a + b) for n in names})

    def span(kind: int) -> Callable[[Column, Column], Column]:
        return lambda match, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"))

    none = F.array().cast(f"array<{SPAN}>")
    df = df.withColumns({n: F.coalesce(F.zip_with(f"_match_{n}", f"_at_{n}", span(patterns[n][1])), none) for n in names})
    return df.drop(*[f"_{part}_{n}" for part in ("match", "gaps", "steps", "at") for n in names])


def segments(text: Column) -> Column:
    """The text in pieces of ``SEGMENT`` code points. To find a place in a text, all that is before it is counted; in a
    piece that is little."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points of a text from ``start`` (from 0), by its ``segments``."""
    first = F.floor(start / SEGMENT).cast("int")
    last = F.floor((start + length) / SEGMENT).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * SEGMENT + 1, length)


def meets_any(spans: Column, span: Column) -> Column:
    """Whether ``span`` overlaps one of ``spans``, which are sorted and don't overlap each other: the last that starts before
    its end is found by halving."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        before = F.get(spans, middle - 1)["start"] < span["end"]
        moves = at["low"] < at["high"]
        return F.struct(F.when(moves & before, middle).otherwise(at["low"]).alias("low"),
                        F.when(moves & ~before, middle - 1).otherwise(at["high"]).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    count = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda at: at["low"])
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(F.get(spans, count - 1)["end"] > span["start"], F.lit(False)))


def named(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of spans by start, then kind in the listed order, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                               s["end"].alias("end"))))
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
