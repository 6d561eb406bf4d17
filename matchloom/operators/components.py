"""Connected components by alternating stars, with hubs joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.materialize import cut

#: Of N edges' ends at most 2 * HOT_SHARE nodes hold N / HOT_SHARE or more: the bound of what is broadcast.
HOT_SHARE = 512
#: Nodes of fewer edges are never broadcast.
LEAST_HOT = 32
#: Rounds grow with the logarithm of the longest path; so many would do for any table that fits a disk.
ROUNDS = 60


def _to_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with the least neighbour m of u. A hub's edges stay where they are, its one row goes to them."""
    hot_from = max(total // HOT_SHARE, LEAST_HOT)
    hubs = F.broadcast(least.filter(F.col("n") >= hot_from).select("u", "m"))
    by_hub = edges.join(hubs, "u").select("u", "v", "m")
    rest = edges.join(hubs, "u", "left_anti").join(least.filter(F.col("n") < hot_from).select("u", "m"), "u").select("u", "v", "m")
    return by_hub.unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _to_least(both.filter("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    down = _to_least(edges, least, total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Has every u one v, and is no v a u? Then each component is a star around its least node."""
    if edges.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, label for every node of the edges (u, v; numbers or strings): label is the least node of its component.

    Alternates large and small stars until there are only stars. Edges stay a distributed table, cut every round; only
    their number comes to the driver. Null ends are ignored; an empty table gives an empty result.
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        total = now.count()
        now = cut(_small_star(cut(_large_star(now, total)), total))
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
