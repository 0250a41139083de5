"""Connected components by alternating star contractions, as joins and map-side aggregations.

Each round points the larger neighbours of a node, then the smaller ones, at the smallest node around
it, until the edges stop changing and every edge leads to its component's smallest node.  Rounds are
written to the shared folder, so a lost executor costs one round at most.  A hub with a third of all
edges is only aggregated (map-side) and joined by equi-joins whose large side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 100  # the algorithm needs O(log^2 n); more means a defect, and is an error


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, F.col("u") == F.col("k"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = (edges.join(least, F.col("u") == F.col("k")).where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node of its component.

    Null ends and loops are ignored; an edge may repeat and have either direction; no edge, no row.
    """
    a, b = F.col(left), F.col(right)
    now = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b))
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = written(_small_star(_large_star(now)), "edges")
        if (then := _fingerprint(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
