"""Connected components by alternating large and small stars, all in DataFrames.

Each round links every node's larger neighbours to its smallest neighbour, then
its smaller neighbours to the smallest of them; after a logarithmic number of
rounds every node points at the smallest node of its component.  The minima are
combined before the shuffle and joined back, so no node's neighbours ever meet in
one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and no larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count(F.when(F.expr("up > 1 OR up = 1 AND down = 1"), 1))).first()[0] == 0


def _round(edges: DataFrame) -> DataFrame:
    moved = stored(_small_star(_large_star(edges)), "edges")
    discard(edges)
    return moved


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of an orderable type, a <> b; returns (node, label) for every node but the smallest
    of each component, whose label is itself."""
    edges = stored(edges.select("a", "b").distinct(), "edges")
    if not edges.isEmpty():
        edges = _round(edges)  # one round is seldom enough: not looked at
        while True:
            edges = _round(edges)
            if _done(edges):
                break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
