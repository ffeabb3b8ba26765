"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its smallest
    neighbour. What is left at the end is one star per component. A round is aggregations and joins
    on single nodes, so no component is ever gathered in one place; its links are written to the
    shared folder. Links from a node to itself are ignored; no links give no rows.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while True:
        before = _digest(edges)
        both = edges.union(edges.select(F.col("u"), F.col("v"))).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
        # Large star: every larger neighbour of n is linked to the least of n and its neighbours.
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("v"), F.col("least").alias("u")).distinct()
        # Small star: n and its smaller neighbours are linked to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(least, "v").where("u <> least").select(F.col("u").alias("v"), F.col("least").alias("u"))
        edges = written(small.union(least.select("v", F.col("least").alias("u"))).distinct(), "links")
        if _digest(edges) == before:
            break
    roots = edges.select("u").distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        roots.select(F.col("u").alias("node"), F.col("u").alias("root"))
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
