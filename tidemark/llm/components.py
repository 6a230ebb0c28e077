"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _stars(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with the least number among each node and its neighbours."""
    least = edges.groupBy(node).agg(F.min(other).alias("m"))
    return edges.join(least.select(node, F.least("m", node).alias("m")), node)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): every node that has an edge in (u, v) and the least node it can reach.

    Each round is two groupings and joins on narrow rows, written out before the next, so a lost executor costs one
    round.  Hubs are reduced by a map-side minimum and the joins can be split, so no node's neighbours are gathered.
    Self edges only make their node appear.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        small = _stars(large, "u", "v")
        now = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == before:
            break
        before = (sign["n"], sign["s"])
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
