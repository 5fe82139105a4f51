"""Connected components, for identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import shared_dir


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node of the links; the component is its least node.

    Every node points at the least neighbour that it knows. In each round all
    links are handed to what their ends point at, and pointers are followed once
    more, so a chain of n links needs about log n rounds. A hub's links are
    aggregated before they are shuffled, and a round is written to the shared
    folder. Links with a null end tell nothing.
    """
    shared_dir(links.sparkSession)
    ends = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))
    edges = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("before"))
        # What a node's component has been told counts for the node too.
        told = nearer.groupBy(F.col("before").alias("key")).agg(F.min("component").alias("least"))
        hop = nearer.join(told, nearer["before"] == told["key"]).select("node", F.least("component", "least").alias("component"), "before")
        point = hop.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = hop.join(point, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "before").checkpoint()
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
