"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); root is the component's least node.

    Each round hooks every node to its least neighbour, jumps pointers until trees are flat, and goes on
    with the links between different roots; their number at least halves. Every table of a round is
    written; a hot node's links are reduced by a map-side minimum. Links of a node to itself and repeated
    links change nothing; no links give no rows.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while links.limit(1).count():
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = written(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("up")), "tree")
        while True:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(tree.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "tree")
            tree = jumped.select("node", "up")
            if not jumped.where("moved").limit(1).count():
                break
        if roots is None:
            roots = tree.withColumnRenamed("up", "root")
        else:
            moved = roots.join(tree.withColumnRenamed("node", "root"), "root", "left")
            roots = written(moved.select("node", F.coalesce("up", "root").alias("root")), "roots")
        links = written(
            links.join(tree.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(tree.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
