"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``component`` (the smallest vertex that it reaches) for every vertex of ``links`` (``a``, ``b``: whole numbers).

    Large-star and small-star steps alternate until nothing changes: first every larger neighbour, then every smaller one, is
    linked to the smallest neighbour. Each step is an aggregate and a join of written tables, so Spark can split a vertex with
    a great many links; the number of rounds grows with the logarithm of the longest path.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda e: e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    after = print_of(edges)
    while after[0]:
        before, edges = after, small_star(large_star(edges))
        after = print_of(edges)
        if after == before:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(
        edges.select("v", F.col("v").alias("component")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a vertex goes to the smallest of the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours go to the smallest of these."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
