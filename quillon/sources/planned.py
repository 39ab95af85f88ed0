"""Parallel reads of a database table without bounds set by hand: the database counts, and even parts are cut from the counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.registry import check_table_name, jdbc_options, run_query

#: Cells of a histogram; every level of a hot range has as many.
CELLS = 256


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``, both included, and their rows."""

    low: int
    high: int
    rows: int


def _one(spark: SparkSession, cfg: dict, sql: str):
    return run_query(spark, cfg, sql).first()


def _cells(spark: SparkSession, cfg: dict, table: str, column: str, low: int, high: int, where: str) -> list[Range]:
    """How many rows lie in each cell of a range, as the database counts them: at most ``CELLS`` rows come back."""
    width = max(1, -(-(high - low + 1) // CELLS))
    sql = (f"SELECT g, COUNT(*) AS n FROM (SELECT ({column} - ({low})) / {width} AS g FROM {table} "
           f"WHERE {column} >= {low} AND {column} <= {high} AND {where}) x GROUP BY g")
    # whole numbers divide to whole numbers there; other databases give fractions, which are cut here
    counts: dict[int, int] = {}
    for r in run_query(spark, cfg, sql).collect():
        counts[int(r[0])] = counts.get(int(r[0]), 0) + int(r[1])
    return [Range(low + g * width, min(high, low + (g + 1) * width - 1), n) for g, n in sorted(counts.items())]


def even_ranges(spark: SparkSession, cfg: dict, table: str, column: str, rows_a_part: int, where: str = "1 = 1") -> list[Range]:
    """Ranges of a whole-number column that cover its values, each of about ``rows_a_part`` rows or one value.

    Cells with more rows are counted again in finer cells, down to single values, so the histograms follow the data:
    one query for each range that holds more than a part.
    """
    span = _one(spark, cfg, f"SELECT MIN({column}) AS a, MAX({column}) AS b FROM {table} WHERE {where}")
    if span is None or span[0] is None:
        return []
    todo, fine = [(int(span[0]), int(span[1]))], []
    while todo:
        low, high = todo.pop()
        for cell in _cells(spark, cfg, table, column, low, high, where):
            if cell.rows > rows_a_part and cell.low < cell.high:
                todo.append((cell.low, cell.high))
            else:
                fine.append(cell)
    out: list[Range] = []
    for cell in sorted(fine, key=lambda c: c.low):
        if out and out[-1].rows + cell.rows <= rows_a_part:
            last = out.pop()
            cell = Range(last.low, cell.high, last.rows + cell.rows)
        out.append(cell)
    return out


def planned_predicates(spark: SparkSession, cfg: dict, table: str, column: str, parts: int, spread: str | None = None) -> list[str]:
    """Conditions that cut a table into about ``parts`` even parts; every row, nulls included, meets exactly one.

    A value of ``column`` that alone has more rows than a part is cut further by ``spread``, another whole-number column.
    """
    check_table_name(table)
    total = int(_one(spark, cfg, f"SELECT COUNT(*) AS n FROM {table}")[0])
    size = max(1, -(-total // max(1, parts)))
    out = []
    for r, inside in _conditions(column, even_ranges(spark, cfg, table, column, size)):
        if spread and r.rows > size and r.low == r.high:
            # the value itself is cut; what else may lie up to the next range is a part of its own
            inner = _conditions(spread, even_ranges(spark, cfg, table, spread, size, f"{column} = {r.low}"))
            out += [f"{column} = {r.low} AND {i}" for _, i in inner]
            out += [f"{column} = {r.low} AND {spread} IS NULL", f"{inside} AND {column} <> {r.low}"]
        else:
            out.append(inside)
    return [*out, f"{column} IS NULL"]


def _conditions(column: str, ranges: list[Range]) -> list[tuple[Range, str]]:
    """A condition for each range. They meet without gaps, and the outer ones are open, so that rows that come later are in one."""
    out = []
    for i, r in enumerate(ranges):
        bounds = ([f"{column} >= {r.low}"] if i else []) + ([f"{column} < {ranges[i + 1].low}"] if i + 1 < len(ranges) else [])
        out.append((r, " AND ".join(bounds) or f"{column} IS NOT NULL"))
    return out


def read_planned(spark: SparkSession, cfg: dict, table: str, column: str, parts: int, spread: str | None = None) -> DataFrame:
    """A database table, a task for each of the even parts. No row is in two of them, also none that comes while it is read."""
    options = jdbc_options(cfg, table)
    url, name = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, name, predicates=planned_predicates(spark, cfg, table, column, parts, spread), properties=options)
