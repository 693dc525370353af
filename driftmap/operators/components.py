"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.scale import cut_counting, lookup


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """The smallest node that each node is connected to: ``node, component``, for the nodes in ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and contracts
    the graph to those ends. A node left over after two rounds has absorbed another, so the graph at least halves every
    two rounds. Every table is cut from its lineage, and nodes with very many neighbours never gather in one task.
    ``most`` is a known upper bound of the nodes of one component, hence of the neighbours of a node.
    """
    both_ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links, size = cut_counting(both_ways.filter(F.col("a") != F.col("b")).distinct())
    nodes = size["rows"]
    rounds = []
    while size["rows"]:
        hooks = links.groupBy("a").agg(F.min("b").alias("low"))
        hooks = follow(hooks.select(F.col("a").alias("node"), F.least("a", "low").alias("component")), size["rows"], most)
        rounds.append(hooks)
        for end in ("a", "b"):
            to = hooks.select(F.col("node").alias(end), F.col("component").alias("_to"))
            links = lookup(links, to, [end], "inner", at_most=size["rows"], most=most).drop(end).withColumnRenamed("_to", end)
        links, size = cut_counting(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0]
    for hooks in rounds[1:]:
        to = hooks.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        moved = lookup(labels, to, ["component"], at_most=nodes, most=most)
        labels = moved.select("node", F.coalesce("_to", "component").alias("component"))
    return labels


def follow(hooks: DataFrame, at_most: int, most: int | None = None) -> DataFrame:
    """Replace each hook by the end of its chain; every pass triples the steps taken."""
    while True:
        step = hooks.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        walked = hooks.withColumn("_moved", F.lit(False))
        for _ in range(2):
            walked = lookup(walked, step, ["component"], "inner", at_most=at_most, most=most).select(
                "node", F.col("_next").alias("component"), (F.col("_next") != F.col("component")).alias("_moved")
            )
        hooks, seen = cut_counting(walked, moved=F.col("_moved"))
        hooks = hooks.drop("_moved")
        if not seen["moved"]:
            return hooks
