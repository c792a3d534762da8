"""Connected components of links, in rounds whose number grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.sources.shared import saved


def _flat(up: DataFrame) -> DataFrame:
    """(node, root) of trees (node, up), whose roots point to themselves: pointers double until nothing moves."""
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = saved(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
        if not up.where("moved").limit(1).count():
            return up.select("node", F.col("up").alias("root"))
        up = up.select("node", "up")


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: longs): two nodes have one root if links lead from one to the other.

    A round lets each node point to its least neighbour or itself, which makes trees; these become their roots, and links
    between different roots are left for the next round, at most half as many nodes. A hot node's links are
    reduced to their least before they meet. Each round is written. Links of a node to itself count for nothing but the node.
    """
    left = saved(links.select("a", "b").distinct(), "links")
    roots = None
    while left.limit(1).count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        tree = _flat(saved(up, "pointers"))
        if roots is None:
            roots = tree
        else:
            moved = roots.join(tree.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            roots = saved(moved.select("node", F.coalesce("top", "root").alias("root")), "roots")
        side = lambda x: tree.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))  # noqa: E731, B023
        left = left.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
        left = saved(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots
