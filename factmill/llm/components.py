"""Connected components by alternating large-star and small-star steps; only edges move, none reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, tidy

#: Edges are worked on by a task for each so many, whatever the number of shuffle partitions.
EDGES = 50_000


def _both(now: DataFrame, first, second) -> DataFrame:
    return now.select(F.explode(F.array(first, second)).alias("e")).select("e.*")


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _stars(now: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether every node has one edge to a smaller one, or none, and no node has edges both ways."""
    end = lambda c: F.struct(F.col(c).alias("x"), F.lit(int(c == "u")).alias("up"), F.lit(int(c == "v")).alias("down"))
    each = _both(now, end("u"), end("v")).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    edges, most = each.agg(F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
    return edges or 0, (most or 0) <= 1


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of one orderable type -> (node, root) for every node with an edge; root is the component's smallest node.

    Loops and repeats are ignored, null ends too. The minimum is taken by partial aggregation, and hubs meet their neighbours in
    ordinary joins, which adaptive execution splits; each round is cut by a checkpoint. It ends when all edges lead to their
    component's smallest node, which is checked edge by edge. Few edges take few tasks (EDGES): rounds are many, and what a task
    costs by itself would outweigh them.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    for k in range(most_rounds):
        if k % 3 == 2:
            tidy(now.sparkSession)
        n, settled = _stars(now)
        few = buckets_for(n, EDGES)
        now = now.coalesce(few)
        if settled:
            break
        both = _both(now, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few)
        small = large.join(_smallest(large), "u")
        ends = _both(small, F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = cut(ends.filter("u > v").coalesce(few).distinct().coalesce(few))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return _both(now, F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))).distinct().coalesce(few)
