"""The aggregations behind the visuals of a report page, and its filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.scalars import divide
from quillon.operators.measures import Measure, measures

# Order of the visuals on a page, and how many fields each shows.
PRIORITIES = {"line": 1, "column": 1, "card": 1, "map": 2, "pie": 3, "table": 4}
MEASURE_LIMITS = {"line": 3, "column": 2, "card": 4, "map": 1, "pie": 1}
TABLE_FIELDS = 10


def table_visual(df: DataFrame, measure_fields: Sequence[str], dimension_fields: Sequence[str] = (),
                 fields: int | None = TABLE_FIELDS) -> DataFrame:
    """Detail rows: the first ``fields`` fields, measures first; all of them with None."""
    return df.select(*[F.col(f"`{c}`") for c in [*measure_fields, *dimension_fields][:fields]])


def pie_visual(df: DataFrame, category: str | Column, measure: Measure) -> DataFrame:
    """Value and share of the total per category."""
    per = measures(df, [measure], [category])
    value = F.col(f"`{measure.title}`")
    total = per.agg(F.sum(value).cast("double").alias("total")).scalar()
    return per.withColumn("share", divide(value.cast("double"), total))


def visual(df: DataFrame, kind: str, dims: Sequence[str | Column], specs: Sequence[Measure],
           grain: str = "month", limits: dict[str, int] | None = MEASURE_LIMITS) -> DataFrame:
    """The data of one visual: ``line, column, pie, map, card, table, matrix``.

    A line takes a date as its first dimension and groups it by ``grain``. ``limits`` has the
    number of measures that a kind shows; with None all are computed. A matrix has subtotals from left to right.
    """
    specs = specs[:(limits or {}).get(kind, len(specs))]
    if kind == "line":
        day = F.col(dims[0]) if isinstance(dims[0], str) else dims[0]
        period = F.date_trunc(grain, day.cast("timestamp")).cast("date").alias("period")
        return measures(df, specs, [period, *dims[1:]])
    if kind in ("column", "map"):
        return measures(df, specs, dims[:1])
    if kind == "pie":
        return pie_visual(df, dims[0], specs[0])
    if kind == "card":
        return measures(df, specs)
    if kind == "matrix":
        return df.rollup(*dims).agg(
            *[F.grouping_id().alias("level")], *[m.expression().alias(m.title) for m in specs])
    if kind == "table":
        return table_visual(df, [m.column for m in specs], list(dims))
    raise ValueError(f"unknown visual {kind!r}")


def pivot_visual(df: DataFrame, rows: Sequence[str], across: str, values: Sequence, measure: Measure) -> DataFrame:
    """A matrix with the given values of ``across`` as columns; naming them saves a pass."""
    return df.groupBy(*rows).pivot(across, list(values)).agg(measure.expression())


def visual_bundle(df: DataFrame, specs: Sequence[Measure], date: str | None = None,
                  category: str | None = None, geography: str | None = None,
                  limits: dict[str, int] | None = MEASURE_LIMITS) -> DataFrame:
    """Line, column, pie, map and card data of a page from one scan.

    ``limits`` as for :func:`visual`; a pie shows the first measure. Rows ``(priority, visual, category, measure, value)``; the pie's value is the share.
    """
    def shown(kind: str) -> int:
        return min(len(specs), (limits or {}).get(kind, len(specs)))

    parts: dict[str, Column] = {}
    if date:
        parts["__line"] = F.date_format(F.date_trunc("month", F.col(date).cast("timestamp")), "yyyy-MM")
    if category:
        parts["__column"] = F.col(category)
    if geography:
        parts["__map"] = F.col(geography)
    base = df.withColumns(parts) if parts else df
    names = list(parts)
    sets = [[n] for n in names] + [[]]
    cells = [m.expression().cast("double").alias(f"m{i}") for i, m in enumerate(specs)]
    level = F.grouping_id().alias("level")
    groups = base.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names]).agg(level, *cells) \
        if names else base.agg(F.lit(0).alias("level"), *cells)

    # the level has a bit per grouped-away column, the first column being the highest
    full = (1 << len(names)) - 1

    def entry(kind: str, level: int, category: Column, j: int, value: Column) -> Column:
        return F.when(F.col("level") == level, F.struct(
            F.lit(PRIORITIES[kind]).alias("priority"), F.lit(kind).alias("visual"),
            category.cast("string").alias("category"), F.lit(specs[j].title).alias("measure"),
            value.alias("value")))

    entries = [entry("card", full, F.lit(None), j, F.col(f"m{j}")) for j in range(shown("card"))]
    for i, n in enumerate(names):
        kind, level = n.removeprefix("__"), full - (1 << (len(names) - 1 - i))
        entries += [entry(kind, level, F.col(n), j, F.col(f"m{j}"))
                    for j in range(shown(kind))]
        if kind == "column":
            # all measures are asked for, so that the total comes from the same shuffled groups
            totals = groups.where(F.col("level") == full).select(
                F.struct(*[f"m{j}" for j in range(len(specs))])).scalar()
            entries.append(entry("pie", level, F.col(n), 0, divide(F.col("m0"), totals["m0"])))
    return groups.select(F.inline(F.array_compact(F.array(*entries)))).orderBy(
        "priority", "visual", "category", "measure")


def apply_filters(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Report filters: ``date_range`` (``last_12_months`` up to the last date present, or
    ``start``/``end``) and ``dropdown`` with the chosen ``values``."""
    for f in filters:
        col = F.col(f["field"])
        if f["type"] == "date_range":
            day = col.cast("date")
            if f.get("range") == "last_12_months":
                last = df.agg(F.max(day).alias("last")).scalar()
                df = df.where((day >= F.add_months(last, -12)) & (day <= last))
            else:
                df = df.where(day.between(F.lit(f["start"]).cast("date"), F.lit(f["end"]).cast("date")))
        elif f["type"] == "dropdown":
            df = df.where(col.isin(list(f["values"])))
        else:
            raise ValueError(f"unknown filter type {f['type']!r}")
    return df


def suggest_visuals(fields_df: DataFrame) -> DataFrame:
    """Rows ``(table, visual, priority, measures, dimension)`` that a table's fields allow, in
    the order of their positions."""
    per = fields_df.withColumn("at", F.col("position")).groupBy("table").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "measure", F.struct("at", "column")))).alias("m"),
        *[F.min(F.when((F.col("role") == "dimension") & (F.col("suggestion") == s),
                       F.struct("at", "column")))["column"].alias(s) for s in ("time", "geography", "category")])
    names = F.transform("m", lambda x: x["column"])

    def row(kind: str, dimension: Column, needed: Column) -> Column:
        shown = F.slice(names, 1, MEASURE_LIMITS.get(kind, TABLE_FIELDS))
        return F.when(needed, F.struct(
            F.lit(kind).alias("visual"), F.lit(PRIORITIES[kind]).alias("priority"),
            F.array_join(shown, ",").alias("measures"), dimension.alias("dimension")))

    some, none = F.size("m") > 0, F.lit(None).cast("string")
    rows = F.array_compact(F.array(
        row("line", F.col("time"), some & F.col("time").isNotNull()),
        row("map", F.col("geography"), some & F.col("geography").isNotNull()),
        row("column", F.col("category"), some & F.col("category").isNotNull()),
        row("pie", F.col("category"), some & F.col("category").isNotNull()),
        row("card", none, some), row("table", none, F.lit(True))))
    return per.select("table", F.inline(rows))
