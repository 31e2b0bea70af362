"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are a minimum per node and a join back on the node, so a hub of any size is a skewed join
that Spark can split, never a group gathered in one task. Every round is written to the shared
checkpoint folder. The edges end as stars around the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywatch.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``u, v`` with u < v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    else:
        # Neighbours not above a node, seen from the node: edges point from v down to u.
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        out = edges.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
        out = out.unionByName(low.select(F.col("m").alias("u"), "v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge goes from a smallest node to a node of no other edge: nothing is left to do."""
    ends = edges.groupBy("v").agg(F.count("*").alias("n"))
    seen = edges.select(F.col("u").alias("v")).distinct().withColumn("start", F.lit(True))
    return ends.join(seen, "v", "left").filter((F.col("n") > 1) | F.col("start")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; root is the component's smallest node."""
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = materialise(edges, "edges")

    while not _stars(edges):
        edges = materialise(_star(_star(edges, True), False), "edges")
    roots = edges.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
