"""Connected components by repeated contraction, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node of the edges; nodes of one component share a label, the least of its nodes.

    Each round maps every node to the one of least hash among itself and its neighbours, and the edges to the
    images of their ends; what has become a loop goes. A node's label is the composition of its maps. The hash differs
    from round to round, so that no order of the nodes makes paths shrink slowly: rounds grow with the logarithm of the
    nodes. Each is reduced before its shuffle, so a node with very many neighbours is no hot spot, and is
    written to the checkpoint folder.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    rest = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    turn = 0
    while not rest.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        image = cut(both(rest).groupBy("u").agg(F.min(ranked("v")).alias("m")).select("u", F.least(ranked("u"), "m")["n"].alias("m")))
        if labels is None:
            labels = image.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            moved = image.where("u <> m").select(F.col("u").alias("label"), "m")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("m", "label").alias("label"))
        labels = cut(labels)
        step = rest.join(image.select(F.col("u").alias("a"), F.col("m").alias("x")), "a").join(image.select(F.col("u").alias("b"), F.col("m").alias("y")), "b")
        rest = cut(step.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    if labels is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("label")).where(F.lit(False))
    # the node that is left need not be the least of its component
    ends = labels.groupBy("label").agg(F.min("node").alias("_least"))
    return labels.join(ends, "label").select("node", F.col("_least").alias("label"))
