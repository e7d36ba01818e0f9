"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return not several.take(1) and not edges.join(edges.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").take(1)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """`node, component` for every node of `edges` (u, v: long); a component's label is its smallest node.

    Loops, null ends and repeated or reversed edges are harmless; an empty edge list gives an empty table. Each round is
    two aggregations and two equi-joins on the node, written to the shared folder; nothing but whether all are stars
    reaches the driver, and no broadcast, of which many rounds would leave much there. The number of rounds grows with the
    logarithm of the component size.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(edges):
            break
        # Large star: each node links its larger neighbours to the smallest node it knows.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low.hint("merge"), "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
