"""Connected components of a link table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import forget, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each node with the lowest of itself and what it is paired with, written so that the join can split hubs."""
    return written(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star")


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: long columns a, b. Returns (node, root): every linked node with the lowest node of its component.

    Each round is two joins on a node and two aggregates with map-side combination; tables between
    rounds live in the shared folder. Rounds grow with the logarithm of the longest chain. An empty
    table, loops (a = b), nulls and repeated links are accepted; null ends are no link.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both)
        large = written(both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        forget(low)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = _lowest(down)
        small = down.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for old in (edges, large, low):
            forget(old)
        edges = after
        if seen == before:
            break
        before = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
