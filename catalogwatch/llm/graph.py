"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from catalogwatch.llm.store import settle


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour v of u with the smallest of u and its neighbours.

    The minimum is combined before its shuffle, and the join back may be split by the engine, so a node with very
    many neighbours doesn't meet in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger node to the smaller one when it comes in."""
    near = _nearest(edges)
    hung = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)``: every node with an edge, and the smallest node it reaches.

    Every round is written to the shared folder. It ends when a round changes nothing: no bound on rounds, sizes or
    diameters. Loops and repeated edges are dropped; an empty table gives an empty table.
    """
    state = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-edges")
    before = None
    while True:
        seen = Observation()
        state = settle(
            _small_star(_large_star(state)).observe(
                seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
            ),
            f"{tag}-round",
        )
        now = (seen.get["n"], seen.get["h"])
        if now == before or not now[0]:
            break
        before = now
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
