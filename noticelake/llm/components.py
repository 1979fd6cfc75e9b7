"""Connected components of a large edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links of long ids to (id, component_id): every linked node and the smallest node that it reaches.

    Each round is written to the shared folder; the driver sees only a count and a checksum of it. Nodes without
    links do not appear; links of a node with itself and null ends are ignored. Every node has links to smaller
    nodes only, and the smallest node of a component takes over all links in a few rounds, whose number grows
    with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, before = materialize(edges, "cc"), None
    for _ in range(most_rounds):
        last, edges = edges, materialize(_small_star(_large_star(edges)), "cc")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
