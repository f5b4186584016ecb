"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import cut


#: Edges that one task stores.
EDGES_PER_TASK = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """For each ``a``, the smallest of it and its partners ``b``."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger ``a`` to the smaller ``b``."""
    joined = edges.join(_least(edges), "a")
    links = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return links.union(joined.select("a", F.col("low").alias("b"))).where("a > b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links (``a``, ``b``) connect it with; roots themselves included.

    Every round stores its edges in the shared folder and compares two sums with those of the round before. Rounds
    grow with the logarithm of a component's size. Null nodes and links of a node with itself do not count.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    parts = max(-(-edges.count() // EDGES_PER_TASK), 1)  # rounds never add edges
    edges, before = edges.coalesce(parts), None
    while True:
        edges = cut(_small_star(_large_star(edges)).distinct().coalesce(parts))
        hashes = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), hashes).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
