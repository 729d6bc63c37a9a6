"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.session import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Alternating star steps: first every node hands its larger neighbours to its least one, then its
    smaller neighbours and itself. The links shrink to stars around the least nodes in a number of
    rounds that grows with the logarithm of the longest path. Each round is written to the shared
    folder. A node of very many links is only ever a key of sums and of joins with one row per key.
    """
    edges = materialise(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = large.join(least, large["u"] == least["w"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        new = materialise(_down(small), "links")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            release(edges)
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        release(edges)
        edges, before = new, now


def _down(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
