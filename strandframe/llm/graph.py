"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, settled


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """The smallest neighbour `m` of each `u`, with its degree; map-side combined, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_degree"))


#: Edges of a partition: a few of them in many partitions cost files in every round.
PART = 200_000


def _star(edges: DataFrame, total: int) -> DataFrame:
    minimum = cut(_neighbour_minimum(edges).coalesce(total // PART + 1))
    return attach(edges, minimum, "u", "_degree", total)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges(a, b)` to `(node, root)`: for each node of an edge the smallest node it reaches.

    Each round moves all larger neighbours of a node to its smallest one (large star), then all smaller
    ones (small star), which takes a number of rounds in the logarithm of the longest path. It ends when a
    round changes nothing. Every round is checkpointed: the plan doesn't grow and an executor may be lost.
    Edges with a null end and loops are left out; an empty table gives an empty result.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut(large.coalesce(2 * now["n"] // PART + 1))
        small = _star(large, now["n"])
        edges = settled(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct().coalesce(now["n"] // PART + 1))
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
