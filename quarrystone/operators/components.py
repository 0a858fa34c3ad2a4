"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import discard, shuffled, staged


def _fingerprint(edges: DataFrame) -> tuple:
    """One small row for a table of different edges: tables with the same one are taken as equal."""
    mixed = [F.bit_xor(F.xxhash64("u", "v", F.lit(seed))) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *mixed).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternates hooking every node's neighbours onto its smallest neighbour with hooking them onto smaller ones, so the
    number of rounds grows with the logarithm of the longest path. Each round is a grouped minimum (combined before
    the shuffle) over at most as many edges as given; a hub's edges are never gathered in one row or one task, as the
    minimum is joined back to them. Null ends are ignored, a self-loop makes its node a component of its own, repeated
    edges change nothing, and an empty list gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = staged(pairs.select("u").union(pairs.select("v")).distinct(), "nodes")
    current = staged(pairs.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    before = _fingerprint(current)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u, onto the smallest of u and its neighbours
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u and u itself, onto the smallest of them
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(shuffled(least), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, current = current, staged(small.select("v", "u"), "edges")
        discard(last, large)
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.select(F.col("u").alias("node")).join(shuffled(current.select(F.col("u").alias("node"), "v")), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
