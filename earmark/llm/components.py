"""Connected components by alternating star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import cut_lineage


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of u below the smallest node around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("low", F.least("low", "u"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours below the smallest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` of all nodes that `links(u, v)` touch, except the roots themselves.

    The root is the smallest node of the component. Rounds are few: both steps at least square the
    number of nodes that one star holds. Each round is written to the shared folder.
    """
    edges = cut_lineage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        # Done when every node has one parent and no parent has a parent: edges are stars.
        children = edges.groupBy("u").agg(F.count("*").alias("n"))
        deep = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
        if children.where("n > 1").isEmpty() and deep.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = cut_lineage(_small_star(_large_star(edges)))
