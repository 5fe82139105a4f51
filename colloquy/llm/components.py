"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut_small

def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its least node already."""
    inner = edges.select(F.col("v").alias("u")).distinct()
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return several.unionByName(edges.join(inner, "u", "left_semi").select("u")).isEmpty()


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the least node reachable.

    Each round runs a large star (hand every larger neighbour to the least one)
    and a small star (hand every smaller neighbour, and oneself, to the least
    one), so a chain of length n shrinks to a star in about log n rounds. All
    steps are aggregations and equi-joins that adaptive execution can split;
    each round is written to the shared folder, which cuts the lineage. Null
    ends and self-links are ignored. An empty table gives an empty result.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).isNull().alias("ln"), F.col(right).isNull().alias("rn"))
    edges = cut_small(edges.where("not ln and not rn and u <> v").select("u", "v").distinct())
    while not _settled(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut_small(small)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
