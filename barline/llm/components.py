"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import written


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself), doubles
    these pointers until they all end at nodes that are smallest among their
    neighbours, and contracts the edges to those. All other nodes go away in
    each round, so rounds, and jumps within a round, are logarithmic. Nothing is
    collected: only the count of edges left reaches the driver. Degrees may be
    skewed: minima are combined before the shuffle, and joins are ordinary
    sort-merge joins that adaptive execution may split. Tables between the steps
    are files, whose size Spark knows: a checkpoint keeps the estimate of its plan,
    a join's is the product of its inputs', and after some jumps that number alone
    takes minutes. Self-loops and repeated edges are harmless; an empty table
    gives an empty result.
    """
    left = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    labels = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select(F.col("b"), F.col("a")))
        low = written(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("p")), "low")
        while True:
            jump = written(low.join(low.select(F.col("node").alias("p"), F.col("p").alias("q")).hint("merge"), "p").select("node", "p", "q"), "jump")
            low = jump.select("node", F.col("q").alias("p"))
            if jump.where("p <> q").isEmpty():
                break
        moved = low
        if labels is None:
            labels = moved.select("node", F.col("p").alias("component"))
        else:
            nxt = moved.select(F.col("node").alias("component"), F.col("p").alias("_p"))
            labels = labels.join(nxt.hint("merge"), "component", "left").select("node", F.coalesce("_p", "component").alias("component"))
        labels = written(labels, "labels")
        to = lambda c: moved.select(F.col("node").alias(c), F.col("p").alias(f"_{c}")).hint("merge")
        left = written(left.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
