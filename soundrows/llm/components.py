"""Connected components of a graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.session import stored


def components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link: (node, component), the least node of it.

    ``links`` has the columns a and b.  In each round every node hooks to its least
    smaller neighbour, chains of hooks are halved until they end, and links move to the
    ends; rounds go on until no link joins two components.  Everything is joins and
    aggregates over links; nothing is collected.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.filter("a != b").select(least.alias("a"), most.alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.withColumn("component", F.col("node")), "nodes")
    while edges.limit(1).count():
        hooks = flattened(stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks"))
        labels = stored(follow(labels, "component", hooks), "labels")
        moved = follow(follow(edges, "a", hooks), "b", hooks).filter("a != b")
        edges = stored(moved.select(least.alias("a"), most.alias("b")).distinct(), "links")
    return labels


def follow(frame: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """The frame with the column's nodes replaced by what they hook to."""
    up = hooks.select(F.col("node").alias("_from"), F.col("up").alias("_to"))
    joined = frame.join(up, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def flattened(hooks: DataFrame) -> DataFrame:
    """Hooks that all lead to a node without a hook: chains are halved until none is left."""
    while True:
        up = hooks.select(F.col("node").alias("_from"), F.col("up").alias("_to"))
        joined = hooks.join(up, F.col("up") == F.col("_from"), "left")
        if not joined.filter("_to is not null").limit(1).count():
            return hooks
        hooks = stored(joined.select("node", F.coalesce("_to", "up").alias("up")), "hooks")
