"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._common import materialise, remove


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge between different nodes; the component is its smallest node.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest
    neighbour, until all components are stars. Rounds are materialised, and their number follows the
    logarithm of the longest path.
    The minima are materialised before they are joined, so the join of a node with very many
    neighbours reads plain exchanges, which Spark can split.
    Null ends and loops are ignored; no edges give an empty result.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    while not is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        smallest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = materialise(small.select("e.*").where("u <> v").distinct(), "edges")
        for step in (least, large, smallest, edges):
            remove(step, spark)
        edges = following
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each larger end u has one edge and no smaller end v is a larger one elsewhere; then v is the component."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("m")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("m")).distinct())
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 1 OR (n > 0 AND m > 0)").isEmpty()
