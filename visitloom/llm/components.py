"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


#: Up to so many edges the least neighbours of all nodes are sent to all executors; beyond, hubs are left to skew joins.
BROADCAST_EDGES = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of one orderable type -> (node, component), component = least node.

    Each round is two aggregations and two joins over the edge list; a hub's neighbours are
    folded by ``min`` where they lie, and the one row that is left of each node is sent to all executors while edges are few. Beyond
    that the join is a shuffle whose skewed partitions Spark splits. Null ends and loops are ignored; nodes
    without an edge do not appear. No edges: an empty table.
    """
    e = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct(),
        "edges",
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        send = F.broadcast if mark[0] <= BROADCAST_EDGES else lambda t: t
        nxt = written(_small_star(_large_star(e, send), send), "edges")
        new = _mark(nxt)
        drop_written(e)
        e, mark, done = nxt, new, new == mark
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(r)


def _large_star(e: DataFrame, send) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(send(least), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(e: DataFrame, send) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        e.join(send(least), "u").where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
