"""Connected components of an edge table by alternating large and small stars; nothing is collected but whether they are settled.

Nodes are of any type with an order. Every round writes its edges as a table, so a lost executor costs one round at
most; stars are repeated until each component is one, which takes a number of rounds that grows with the logarithm of the
longest path. An empty table has no components; loops and repeated edges change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to the least node of its component. Edges lead to lesser nodes."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1").isEmpty()


def _star(edges: DataFrame, large: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Large star: links each larger neighbour of a node with the least of the neighbourhood; small star: the others."""
    if large:
        from_all = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        from_all = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = from_all.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = keep(least)  # read from a table, the join's two sides are dealt anew, and a hot node can be split
    met = from_all.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.filter("a <> b")
    return out if large else out.distinct()


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(node, component) for every node with a link in (a, b); the component is its least node. ``keep`` stores tables."""
    edges = keep(links.select("a", "b").filter("a <> b"))
    while True:
        edges = keep(_star(_star(edges, True, keep), False, keep))
        if _settled(edges):
            break
    # settled edges lead from each node to the least one
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
