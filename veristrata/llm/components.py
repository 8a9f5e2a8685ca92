"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: Edges of one node that are joined in one task.
HUB = 500


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round points every node, and every larger neighbour, at the smallest neighbour
    (large star), then does the same among smaller neighbours (small star). Both are one
    min-aggregation, combined before the shuffle, and one join; the graph shrinks to stars in
    a number of rounds that is logarithmic in practice. Every round is written to the shared
    folder, so a lost executor repeats one round at most. Nothing is collected but two sums.
    """
    state = _pairs(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    table, seen = cut(state), None
    for _ in range(max_rounds):
        total = table.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).first()
        if (now := (total["n"], total["s"], total["t"])) == seen or not total["n"]:
            break
        seen = now
        both = table.select("u", "v").unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select("u", F.least("u", "w").alias("w"), F.ceil(F.col("n") / HUB).cast("int").alias("parts")))
        # An edge (u, v) with u > v: v's star sends u to v's lowest neighbour; u itself goes to u's.
        large = _pairs(
            _lowered(table, lowest).unionByName(lowest.select("u", F.col("w").alias("v")))
        )
        lower = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(lower.select("u", F.col("w").alias("v")))
        table = cut(_pairs(small))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _lowered(table: DataFrame, lowest: DataFrame) -> DataFrame:
    """Each edge (u, v) to v's lowest neighbour. The edges of a hub, of which there are few, are dealt to as many tasks as ``lowest`` says."""
    hubs = lowest.where("parts > 1").select(F.col("u").alias("v"), "parts")
    if not hubs.head(1):
        return table.join(lowest.select(F.col("u").alias("v"), "w"), "v").select("u", F.col("w").alias("v"))
    share = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = table.join(maybe_broadcast(hubs), "v", "left").select("u", "v", share.alias("part"))
    ends = lowest.select(F.col("u").alias("v"), "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(ends, ["v", "part"]).select("u", F.col("w").alias("v"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
