"""Exact quantiles of many columns without sorting or collecting a column.

The built-in exact percentile keeps every distinct value of a column in one task. Here a sketch shows
between which values each wanted rank lies, and only the values between them are counted one by one, exactly. Where these are too
many, histograms with a bounded number of bins narrow the bounds first. A value held by any share of the
rows is one counted row, and all passes combine before they shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.types import value_or_null
from quillon.operators.catalog import local_frame

#: Values between two bounds, from which on they are counted one by one.
COUNTED = 1 << 20
#: Size of the sketch that gives the first bounds, and how far in rank they lie from what is wanted: four times its error.
SKETCH = 2048
REACH = 0.01
LINEAR_BINS = 1 << 16
BINS_PER_DOUBLING = 1 << 8
LARGEST = 8e307


def long_numbers(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-missing cell: the kept columns, ``column`` and ``value``."""
    held = {c: f"__keep_{i}" for i, c in enumerate(keep)}
    wide = df.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()],
                     *[value_or_null(df, c).cast("double").alias(c) for c in columns])
    cells = wide.unpivot(list(held.values()), [F.col(f"`{c}`") for c in columns], "column", "value")
    return cells.where("value IS NOT NULL").withColumnsRenamed({k: c for c, k in held.items()})


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """A bin number that never falls as the value rises.

    Equal steps between the extremes come first and equal steps of the logarithm second, so
    that narrow clusters and long tails both spread. As both rise with the value, the bins in
    use are at most the sum of the steps, not their product.
    """
    def held(c: Column) -> Column:
        return F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))

    step = F.coalesce(F.floor(F.try_divide(held(value) - held(lo), held(hi) - held(lo)) * LINEAR_BINS), F.lit(0))
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(LARGEST))) * BINS_PER_DOUBLING)
    # the smallest positive double has the logarithm -1074
    signed = F.when(value == 0, 0).otherwise(F.signum(value).cast("bigint") * (size + 1075 * BINS_PER_DOUBLING))
    return step * (1 << 24) + signed


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per non-missing cell: the number of its column, which is a cheaper key than its name, and its value."""
    return df.select(F.posexplode(F.array(*[
        value_or_null(df, c).cast("double") for c in columns])).alias("column", "value")).where("value IS NOT NULL")


@dataclass(frozen=True)
class Bracket:
    """Values of a column from ``lo`` to ``hi``: how many there are, and how many are smaller."""

    column: int
    lo: float
    hi: float
    rows: int
    below: int

    @property
    def settled(self) -> bool:
        return self.lo == self.hi


def _inside(cells: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Cells with the number of the bracket they lie in; there are a few brackets per column, however many rows."""
    rows = [(b.column, i, b.lo, b.hi) for i, b in enumerate(brackets)]
    spans = local_frame(cells.sparkSession, rows, "column int, bracket int, lo double, hi double")
    return cells.join(F.broadcast(spans), "column").where(F.col("value").between(F.col("lo"), F.col("hi")))


def _at_ranks(counted: DataFrame, order: list[str], wanted: dict[int, list[int]], below: list[Bracket]) -> list:
    """The row of ``counted`` (``bracket, rows, lo, hi``) that holds each wanted rank: ``(bracket, rank, lo, hi, rows, end)``."""
    upto = Window.partitionBy("bracket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    places = [(i, r, r - below[i].below) for i, ranks in wanted.items() for r in ranks]
    ranks = local_frame(counted.sparkSession, places, "bracket int, rank bigint, place bigint")
    found = counted.withColumn("end", F.sum("rows").over(upto)).join(F.broadcast(ranks), "bracket").where("end > place")
    return found.groupBy("bracket", "rank").agg(
        F.min_by(F.struct("lo", "hi", "rows", "end"), "end").alias("at")).select("bracket", "rank", "at.*").collect()


def _values_at(df: DataFrame, columns: list[str], ranks: dict[int, list[int]], brackets: list[Bracket]) -> dict:
    """The value at each rank wanted in a bracket, by the numbers of column and rank."""
    cells = _cells(df, columns)
    values, stuck = {}, False
    while ranks:
        wide = not stuck and any(brackets[i].rows > COUNTED and not brackets[i].settled for i in ranks)
        for i in [i for i in ranks if brackets[i].settled]:
            values |= {(brackets[i].column, r): brackets[i].lo for r in ranks.pop(i)}
        if not ranks:
            break
        index = list(ranks)
        todo, wanted_here = [brackets[i] for i in index], {n: ranks[i] for n, i in enumerate(index)}
        inside = _inside(cells, todo)
        if not wide:
            counted = inside.groupBy("bracket", F.col("value").alias("lo")).agg(F.count("*").alias("rows"))
            counted = counted.select("bracket", "lo", F.col("lo").alias("hi"), "rows")
            for r in _at_ranks(counted, ["lo"], wanted_here, todo):
                values[todo[r.bracket].column, r["rank"]] = r.lo
            break
        binned = inside.groupBy("bracket", _bin(F.col("value"), F.col("lo"), F.col("hi")).alias("bin")).agg(
            F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        binned = binned.select("bracket", "bin", "rows", F.col("low").alias("lo"), F.col("high").alias("hi"))
        narrow: dict[Bracket, list[int]] = {}
        for r in _at_ranks(binned, ["bin"], wanted_here, todo):
            old = todo[r.bracket]
            narrow.setdefault(Bracket(old.column, r.lo, r.hi, r["rows"], old.below + r.end - r["rows"]), []).append(r["rank"])
        stuck = set(narrow) == set(todo)  # nothing but values beyond the largest that bins tell apart
        brackets, ranks = list(narrow), dict(enumerate(narrow.values()))
    return values


def _counted(df: DataFrame, columns: list[str], brackets: list[Bracket], values: bool) -> DataFrame:
    """``bracket, lo, hi, rows``: the values in each bracket, and as null all smaller ones together. Without ``values`` those
    in it are one row too, whose value is the bracket's upper end."""
    rows = [(b.column, i, b.lo, b.hi) for i, b in enumerate(brackets)]
    spans = local_frame(df.sparkSession, rows, "column int, bracket int, low double, high double")
    each = _cells(df, columns).join(F.broadcast(spans), "column").where("value <= high")
    key = F.when(F.col("value") >= F.col("low"), F.col("value") if values else F.col("high"))
    return each.groupBy("bracket", key.alias("lo")).agg(F.count("*").alias("rows")).withColumn("hi", F.col("lo"))


def percentiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Rows ``(column, p, n, value)``: quantiles by linear interpolation, missing values left out.

    One aggregation gives the extremes of all columns and, by a sketch, bounds around the wanted ranks, which hold a
    hundredth of the values or two. A second pass counts the values between the bounds one by one and all others together, so
    the result is exact. Where a bound should fail, or more than ``COUNTED`` values lie between them, histograms
    narrow the bounds in further passes: each divides what is left by 65,536. What comes to the driver is some rows per column and
    quantile. A column without values gives no row.
    """
    probs = sorted(set(float(p) for p in probs))
    edges = sorted({e for p in probs for e in (max(0.0, p - REACH), min(1.0, p + REACH))})
    held = [value_or_null(df, c).cast("double") for c in columns]
    spans = df.agg(F.array(*[F.struct(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.array(*[
            F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, SKETCH), F.lit(e))) for e in edges]).alias("at"))
        for v in held]).alias("spans")).first()["spans"]
    places = {(i, p): (s.n - 1) * p for i, s in enumerate(spans) if s.n for p in probs}
    wanted = [sorted({f(x) for (c, _), x in places.items() if c == i for f in (math.floor, math.ceil)})
              for i in range(len(columns))]
    brackets, ranks = [], {}
    for (i, p), place in places.items():
        s = spans[i]
        lo = s.lo if p <= REACH else s.at[edges.index(max(0.0, p - REACH))]
        hi = s.hi if p >= 1 - REACH else s.at[edges.index(min(1.0, p + REACH))]
        ranks[len(brackets)] = sorted({math.floor(place), math.ceil(place)})
        brackets.append(Bracket(i, lo, hi, s.n, 0))
    values: dict = {}
    if brackets and 2 * REACH * max(s.n for s in spans) <= COUNTED:
        found = _at_ranks(_counted(df, columns, brackets, True), ["lo"], ranks, brackets)
        values = {(brackets[r.bracket].column, r["rank"]): r.lo for r in found if r.lo is not None}
    elif brackets:
        counts = {(r.bracket, r.lo is None): r["rows"] for r in _counted(df, columns, brackets, False).collect()}  # two numbers a bracket
        brackets = [Bracket(b.column, b.lo, b.hi, counts.get((i, False), 0), counts.get((i, True), 0)) for i, b in enumerate(brackets)]
        sure = {i: [r for r in w if brackets[i].below <= r < brackets[i].below + brackets[i].rows] for i, w in ranks.items()}
        values = _values_at(df, columns, {i: w for i, w in sure.items() if w}, brackets)
    # ranks that the sketch's bounds missed are looked for between the extremes
    missed = {i: [r for r in w if (i, r) not in values] for i, w in enumerate(wanted)}
    whole = {i: Bracket(i, spans[i].lo, spans[i].hi, spans[i].n, 0) for i, w in missed.items() if w}
    if whole:
        values |= _values_at(df, columns, {n: missed[i] for n, i in enumerate(whole)}, list(whole.values()))
    rows = []
    for (i, p), place in places.items():
        low, high = values[i, math.floor(place)], values[i, math.ceil(place)]
        rows.append((columns[i], p, spans[i].n,
                     low if low == high else low + (high - low) * (place - math.floor(place))))
    return local_frame(df.sparkSession, rows, "column string, p double, n bigint, value double")


def quantile_table(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """One row per column with a named column per quantile."""
    found = percentiles(df, columns, list(probs.values()))
    picks = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(name) for name, p in probs.items()]
    return found.groupBy("column").agg(*picks)


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Quartiles and the outlier fences of every column."""
    quart = quantile_table(df, columns, {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * factor
    return quart.withColumns({"lower_bound": F.col("q1") - reach, "upper_bound": F.col("q3") + reach})
