"""Connected components over a table of links, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written


def _settled(hops: DataFrame) -> DataFrame:
    """``node, root`` with every node led to the end of its chain of hops, three times as far in every step."""
    while True:
        second = hops.select(F.col("node").alias("root"), F.col("root").alias("next"))
        third = hops.select(F.col("node").alias("next"), F.col("root").alias("top"))
        after = written(hops.join(second, "root").join(third, "next").select(
            "node", F.col("top").alias("root"), (F.col("top") != F.col("next")).alias("moved")), "hops")
        hops = after.select("node", "root")
        if after.where("moved").isEmpty():
            return hops


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``a, b`` of one ordered type): the smallest node it is linked to.

    In a round every node hops to its smallest neighbour, if that is smaller (a minimum, which combines before the
    shuffle, so that a node with very many links is one row per task), chains of hops are followed to their ends, and
    each link becomes one between the ends of its nodes. Links within one end go, so the table shrinks by more than
    half of its nodes each round, a group of copies around one node to nothing in the first. Rounds end when no link is left. All
    steps are written tables. Loops and repeated links do no harm; without links there are no rows.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "edges")
    roots = None
    while roots is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hops = written(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "hops")
        hops = _settled(hops)
        if roots is None:
            roots = hops
        else:
            further = hops.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = written(roots.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        edges = edges.join(hops.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        edges = edges.join(hops.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        edges = written(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots
