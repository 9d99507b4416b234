"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.sources.writers import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it instead."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = (
        edges.join(least, "b")
        .where(F.col("a") != F.col("m"))
        .select("m", F.col("a").alias("b"))
    )
    return moved.select(F.col("m").alias("a"), "b").unionAll(
        least.select(F.col("m").alias("a"), "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named after its
    smallest node, which itself has no row.

    Alternates two steps that replace links by links to smaller nodes until each node has a
    single link, to the smallest node of its component; the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder, which cuts the
    lineage.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = links.select(least.alias("a"), most.alias("b")).where("a < b").distinct()
    edges = materialize(edges, "edges")
    while True:
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        # Done when every node is either a name or has one link: then both steps change nothing.
        state = edges.agg(F.count("*").alias("n"), F.count_distinct("b").alias("nodes")).first()
        if state["n"] == state["nodes"]:
            names = edges.select(F.col("a").alias("b")).distinct()
            if edges.join(names, "b", "left_semi").isEmpty():
                break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
