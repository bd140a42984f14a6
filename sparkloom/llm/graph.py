"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    A label is a node of the same component that is not larger. In each round a node
    takes the smallest label among its neighbours, hands it to the node that it had as
    its label, and then follows its new label once. So whole regions of one label move
    together and a chain of n nodes in any order takes about log n rounds (11 for 300
    shuffled ones, 22 for 100,000). Each round but the last lowers a label, so the loop
    ends by itself. Aggregations combine before the exchange. The joins by a node's id
    bring the rows of its neighbours together, three ids each; those of a node with very
    many neighbours are split by the adaptive skew join, as the other side has one row.
    Every round is cut to the shared checkpoint folder. Nodes may be of any type that has
    an order. Edges from a node to itself, repeated edges and an empty table are allowed.
    """
    both = cut(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(edges.select(F.col("b"), F.col("a")))
        .where("node <> other")
        .distinct()
    )
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("was"), "near")
        handed = nearer.groupBy("was").agg(F.min("near").alias("handed")).select(F.col("was").alias("node"), "handed")
        hooked = nearer.join(handed, "node", "left").select("node", "was", F.least("was", "near", "handed").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(
            hooked.join(jump, "component", "left").select("node", "was", F.least("component", "further").alias("component"))
        )
        changed = not moved.where("component < was").isEmpty()
        labels = moved.drop("was")
        released(edges.sparkSession)
        if not changed:
            return labels


def tree_roots(parents: DataFrame) -> DataFrame:
    """``node, component`` for every row of ``parents(node, parent)``; the component is the root of its tree.

    A node has one parent, which is smaller. In each round every node takes the parent of
    its parent, so a chain of n nodes takes about log n rounds. A parent with very many
    nodes is split by the adaptive skew join, as the other side has one row.
    """
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        moved = cut(parents.join(up, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved")))
        parents = moved.drop("moved")
        released(parents.sparkSession)
        if moved.where("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
