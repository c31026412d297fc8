"""Connected components of an edge table by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (a, b). Null ends are ignored.

    Every round takes the smallest label among a node's neighbours, then the label's own label, so paths shrink
    geometrically; it ends when nothing changes.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    both = checkpointed(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = checkpointed(labels)
    for _ in range(rounds):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        better = labels.join(near, labels.node == near.u).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = better.join(up, better.label == up._n, "left").select(
            "node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")
        )
        jumped = checkpointed(jumped)
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
