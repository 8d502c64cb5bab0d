"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shelve, unshelve


def _between(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) between different nodes once, the smaller node first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of ``edges`` (u long, v long).

    Each round every node follows the smallest of itself and its neighbours, and then
    that one's choice; edges are redrawn between the nodes that are followed, and
    those within one of them fall away. So the edges get fewer with every round, and
    each is looked up twice. Minima are summed up before they are shuffled, and
    joins with a node that very many edges share have one row per node on the other
    side, so the planner can split them. Each round's tables go with the next.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    labels = shelve(nodes.withColumn("root", F.col("node")))
    live = shelve(_between(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = shelve(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("up")))
        far = up.select(F.col("at").alias("_at"), F.col("up").alias("_up"))
        follow = shelve(up.join(far, up["up"] == far["_at"]).select("at", F.col("_up").alias("to")))
        first = follow.select(F.col("at").alias("_1"), F.col("to").alias("x"))
        second = follow.select(F.col("at").alias("_2"), F.col("to").alias("y"))
        drawn = live.join(first, live["a"] == first["_1"]).join(second, live["b"] == second["_2"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        next_live = shelve(_between(drawn))
        next_labels = shelve(labels.join(follow, labels["root"] == follow["at"], "left").select("node", F.coalesce("to", "root").alias("root")))
        unshelve(live, labels, up, follow)
        live, labels = next_live, next_labels
    unshelve(live)
    return labels
