"""Connected components of links, by alternating stars.

Each round points every neighbour at the smallest id it knows: the large star moves a vertex's larger neighbours, the
small star its smaller ones. Rows never outnumber the links, and rounds grow with the logarithm of a component's
diameter. Every round is written to the shared folder, so no lineage grows and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgate.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (smallest id reachable) for every id in a link; ids are longs. Loops and repeated links are harmless."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        # Large star: neighbours on both sides, the larger ones move to the smallest of all (the vertex itself included).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours and the vertex move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
