"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize


#: Edges one task writes in a round.
ROWS_A_TASK = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable. edges: (u, v) longs; self loops are ignored.

    Stars shrink every tree to depth one in O(log n) rounds. The minimum of a hub's neighbours is pre-aggregated, so a
    hub costs one row per task, and the join back is an equi-join that adaptive execution can split.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = materialize(edges, "edges", "snappy"), None
    rows = edges.count()
    for _ in range(max_rounds):
        # rounds never add nodes: as many tasks as the edges there are ask for, however many partitions a shuffle has
        step = _small_star(_large_star(edges)).distinct().coalesce(rows // ROWS_A_TASK + 1)
        edges = materialize(step, "edges", "snappy")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, rows = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component"), F.col("component"))).distinct()
