"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch


def _flatten(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Replace each parent by the root of its tree: the way to it halves every time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = scratch.store(
            parents.join(up, "parent", "left").select(
                "node", "parent", F.coalesce("above", "parent").alias("above")
            )
        )
        parents = step.select("node", F.col("above").alias("parent"))
        if step.filter("above != parent").isEmpty():
            return parents


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node.

    ``edges`` has the columns a and b.  Each round hooks every node to its smallest
    neighbour if that is smaller, flattens the trees, and goes on with the edges
    between different roots.  Minima are combined before each shuffle, so a node
    with very many edges is no larger for a task than any other.
    """
    edges = scratch.store(edges.filter("a != b").select("a", "b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.store(nodes.select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))
        hooks = scratch.store(both.groupBy("node").agg(F.min("low").alias("parent")))
        roots = _flatten(hooks, scratch)
        to_root = roots.withColumnsRenamed({"node": "component", "parent": "root"})
        labels = scratch.store(
            labels.join(to_root, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
        )
        for side in ("a", "b"):
            root = roots.withColumnsRenamed({"node": side, "parent": "root"})
            edges = edges.join(root, side, "left").withColumn(side, F.coalesce("root", side))
            edges = edges.select("a", "b")
        edges = scratch.store(edges.filter("a != b").distinct())
    return labels
