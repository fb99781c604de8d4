"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node it can reach.

    Contracts until the links stay the same, in about log(longest path) rounds of two shuffles over the links.
    Each round is a written table, so a lost executor costs one round at most. Null ends and links of a node with
    itself are ignored, repeated links count once; no links give no rows.
    """
    tables = Scratch(links.sparkSession, "components")
    edges = tables.table("star", links.select("a", "b").filter("a <> b").distinct())
    nodes = tables.table("nodes", edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    last = None
    while True:
        edges = tables.table("star", _small_star(_large_star(edges).filter("a <> b").distinct()).distinct())
        tables.drop("star", but_last=True)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    found = tables.table("roots", roots.select("node", F.coalesce("root", "node").alias("root")))
    tables.drop("star", "nodes")
    return found
