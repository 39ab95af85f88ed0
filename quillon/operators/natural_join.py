"""Natural join of several tables over all the column names they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


#: Rows that a join may have for each row of its larger side, unless the caller says otherwise.
MAX_GROWTH = 10.0


class JoinTooLarge(ValueError):
    """A join would have far more rows than its tables."""


def join_size(left: DataFrame, right: DataFrame, shared: list[str]) -> dict[str, int]:
    """``left, right, joined, missing, most``: rows of both sides, of their join on ``shared`` names, of its part without a key, and of
    the key with the most, before the join is made. Keys are counted by one shuffle that combines equal ones first."""
    keys = [F.col(f"`{c}`") for c in shared]
    both = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionAll(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    counted = both.groupBy(*keys).agg(F.sum("__l").cast("decimal(38,0)").alias("__left"), F.sum("__r").cast("decimal(38,0)").alias("__right"))
    missing = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
    pairs = F.col("__left") * F.col("__right")
    row = counted.agg(F.sum("__left"), F.sum("__right"), F.sum(pairs), F.sum(F.when(missing, pairs)), F.max(pairs)).first()
    return {name: int(value or 0) for name, value in zip(("left", "right", "joined", "missing", "most"), row)}


def natural_join(tables: dict[str, DataFrame], null_safe: bool = True, drop_null_keys: bool = False,
                 max_growth: float | None = MAX_GROWTH) -> tuple[DataFrame, list[str]]:
    """Fold the tables left to right with an inner join; returns the frame and the skipped names.

    A table that shares no column with the join so far is skipped, never crossed.
    ``null_safe`` lets missing keys meet missing keys. Both forms stay equi-joins, so the
    optimizer picks the strategy and adaptive execution splits a hot key. Where missing
    keys are many and not wanted, ``drop_null_keys`` removes them before the shuffle.

    Keys are counted before each join: one that would have more than ``max_growth`` rows for each row of its larger side,
    because missing keys or repeated ones meet each other, raises :class:`JoinTooLarge`. ``None`` makes it anyway, uncounted.
    """
    names = list(tables)
    joined, skipped = tables[names[0]], []
    for name in names[1:]:
        right = tables[name]
        shared = [c for c in joined.columns if c in right.columns]
        if not shared:
            skipped.append(name)
            continue
        if drop_null_keys:
            joined, right = joined.dropna(subset=shared), right.dropna(subset=shared)
        if max_growth is not None:
            size = join_size(joined, right, shared)
            rows = size["joined"] - (0 if null_safe and not drop_null_keys else size["missing"])
            if rows > max_growth * max(size["left"], size["right"]):
                raise JoinTooLarge(f"{name} on {', '.join(shared)}: {size['left']} and {size['right']} rows would make {rows}, {size['missing']} of "
                                   f"them without a key and {size['most']} with one key; drop_null_keys leaves out missing keys, max_growth=None allows it")
        if not null_safe or drop_null_keys:
            joined = joined.join(right, shared, "inner")
            continue
        twin = {c: f"__right_{i}" for i, c in enumerate(shared)}
        right = right.withColumnsRenamed(twin)
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(t)) for c, t in twin.items()])
        joined = joined.join(right, same, "inner").drop(*twin.values())
    return joined, skipped
