"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.runtime import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected (a, b) edges; a component is
    named by its smallest node.

    Every round hooks each node to its smallest neighbour (a combinable min), follows
    the hooks to their roots by doubling and contracts the edges to roots, so edges shrink
    fast and a node with very many edges is reduced before it is shuffled. Rounds go on
    until no edge is left and are cut by written tables."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    labels = materialize(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        .withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        hooks = _to_roots(both.groupBy("node").agg(F.min("other").alias("m")).select(
            "node", F.least("node", "m").alias("parent")))
        labels = materialize(
            labels.join(hooks.withColumnRenamed("node", "component"), "component", "left")
            .select("node", F.coalesce("parent", "component").alias("component")))
        left, right = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Every node with the root its hooks lead to: each step doubles how far a hook
    reaches, until none moves."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("up"), "parent")
        jumped = materialize(jumped)
        hooks = jumped.select("node", F.col("up").alias("parent"))
        if jumped.where("up <> parent").isEmpty():
            return hooks
