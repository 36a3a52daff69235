"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.storage import stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and u's neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.hint("merge"), "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(edges: DataFrame):
    """Number of edges and an order-free sum over them."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every vertex of ``edges`` (u, v: long) but the least of each.

    ``component`` is the least vertex reachable. Loops and repeated edges do no
    harm; no edges give no rows. The edges are rewritten until they are stars
    around the least vertices; a hot vertex is only ever reduced to a minimum
    and joined with, never gathered.
    """
    edges = stored(edges.filter("u <> v").distinct(), "edges")
    seen = _print(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _print(edges)
        if now == seen:
            return edges.withColumnRenamed("v", "component")
        seen = now
