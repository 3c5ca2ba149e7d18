"""Connected components by contraction, with nodes never leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Each round points every node at its least neighbour, follows the pointers
    to their ends by doubling, replaces nodes by these and drops the loops.
    Ends are less than all their neighbours, so at least half of the nodes that
    still have edges vanish a round, also where nodes descend in a chain.  A
    hub costs one row a neighbour, never pairs.  Rounds are read once more at
    the end, each from the last, so nodes settled early aren't carried on.
    """
    ups: list[DataFrame] = []
    edges = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    while True:
        at = f"{name}-u{len(ups)}"
        both = edges.union(edges.select("b", "a"))
        up = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), at)
        turn = 0
        while True:
            to = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            further = up.select("node", "up").join(to, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            up = scratch.keep(further, f"{at}-{turn}")
            scratch.drop(f"{at}-{turn - 1}" if turn else at)
            if up.where("moved").isEmpty():
                break
            turn += 1
        up = up.select("node", "up")
        ups.append(up)
        step = (
            edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
        edges = scratch.keep(step, f"{name}-e{len(ups)}")
        if edges.isEmpty():
            break
    labels = ups.pop().withColumnRenamed("up", "root")
    for up in reversed(ups):
        labels = up.join(labels.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return labels
