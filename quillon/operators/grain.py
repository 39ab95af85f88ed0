"""The grain of a table: the smallest sets of columns whose values never repeat."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillon.operators.catalog import local_frame

#: Rows that are looked at first: a set that repeats among them is no key, whatever the others hold.
FIRST_ROWS = 50_000
#: Tuples of each set, about, that are looked at next: all rows of a share of the tuples, so that these repeat as in the table.
SCREEN_TUPLES = 1_000_000
#: Tuples that one task compares in the test on all rows, about.
TUPLES_A_TASK = 500_000
#: Sets that one pass over the table tests.
SETS_A_PASS = 24
#: Relative error that an estimated number of distinct values may have, upwards.
ESTIMATE_ERROR = 0.2


def groupable(df: DataFrame) -> list[str]:
    """Columns that can be part of a grain: all but floating-point, map and nested ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.FloatType, T.DoubleType, T.BinaryType))]


def _xor(columns: list[str]) -> Column:
    return reduce(Column.bitwiseXOR, map(F.col, columns))


def _tuples(df: DataFrame, sets: list[tuple[str, ...]], share: int) -> DataFrame:
    """Rows ``(i, a, b)``: the number of the set and 128 bits that stand for its values, of one in ``share`` tuples.

    A null is a value. Equal values have equal bits, so what never repeats is unique. Every cell is hashed once, with its
    column's number; a tuple is the exclusive or of its cells, so that sets add little to the code that runs per row.
    """
    place = {c: n for n, c in enumerate(sorted({c for s in sets for c in s}))}
    cells = []
    for c, n in place.items():
        value = [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
        cells += [F.xxhash64(F.lit(n), *value).alias(f"p{n}"), F.xxhash64(*value[::-1], F.lit(n)).alias(f"q{n}")]
    firsts, seconds = ([_xor([f"{half}{place[c]}" for c in s]) for s in sets] for half in "pq")
    each = df.select(*cells).select(F.posexplode(F.array(*firsts)).alias("i", "a"), F.array(*seconds).alias("seconds"))
    return (each if share == 1 else each.where(F.pmod("a", F.lit(share)) == 0)).select("i", "a", F.col("seconds")[F.col("i")].alias("b"))


def _without_repeats(df: DataFrame, sets: list[tuple[str, ...]], share: int = 1, rows: int | None = None) -> list[tuple[str, ...]]:
    """The sets whose values don't repeat in ``df``, or not among one in ``share`` tuples.

    With ``rows``, their number, most tuples are taken to be unique: combining them before the shuffle would only fill
    memory, so they go as they are to as many tasks as there are tuples for.
    """
    found = []
    for at in range(0, len(sets), SETS_A_PASS):
        part = sets[at:at + SETS_A_PASS]
        each = _tuples(df, part, share)
        if rows is not None:
            each = each.repartition(rows * len(part) // TUPLES_A_TASK + 1, "a")
        repeats = each.groupBy("i", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct()
        bad = {r.i for r in repeats.collect()}  # at most SETS_A_PASS numbers
        found += [s for i, s in enumerate(part) if i not in bad]
    return found


def minimal_keys(df: DataFrame, max_size: int = 3, columns: list[str] | None = None) -> list[tuple[str, ...]]:
    """All sets of up to ``max_size`` columns whose values never repeat and of which no smaller set is one, by size and name.

    Level by level: a set is a candidate if it has no key within, and if the numbers of distinct values of its columns
    multiply to the number of rows at least. Candidates are first tested on some rows, where most of them repeat, then on
    all rows of a share of their tuples, and only the rest on all rows. A null is a value like others. In a table of fewer than two rows every column is a key.
    """
    columns = columns or groupable(df)
    counts = df.agg(F.count("*").alias("rows"), *[(F.approx_count_distinct(F.col(f"`{c}`"), 0.05) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(f"d{i}")
                                                  for i, c in enumerate(columns)]).first()
    rows = counts["rows"]
    most = {c: (counts[f"d{i}"] or 0) * (1 + ESTIMATE_ERROR) + 1 for i, c in enumerate(columns)}
    first = df.select(*[F.col(f"`{c}`") for c in columns]).limit(FIRST_ROWS)
    whole = rows <= FIRST_ROWS
    keys: list[tuple[str, ...]] = []
    for size in range(1, max_size + 1):
        sets = []
        for s in combinations(sorted(columns), size):
            product = 1.0
            for c in s:
                product *= most[c]
            if product >= rows and not any(set(k) <= set(s) for k in keys):
                sets.append(s)
        sets = _without_repeats(first, sets)
        if not whole:
            share = rows // SCREEN_TUPLES + 1
            if share > 1:
                sets = _without_repeats(df, sets, share)
            sets = _without_repeats(df, sets, rows=rows)
        keys += sets
    return keys


def grains(tables: dict[str, DataFrame], max_size: int = 3) -> DataFrame:
    """``table, columns, size`` of every minimal key of every table."""
    spark = next(iter(tables.values())).sparkSession
    return local_frame(spark, [(t, ",".join(k), len(k)) for t, df in tables.items() for k in minimal_keys(df, max_size)],
                       "table string, columns string, size int")
