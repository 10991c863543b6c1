"""Connected components of an undirected graph given by an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its least neighbour (or itself, if less) to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its least neighbour to itself and its other smaller neighbours. Edges point to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id that can be reached) for all ends of the edges (a, b).

    Every round halves the depth of the trees at least; each is written to the shared folder, so that a lost executor
    costs one round. No vertex's edges need to meet in one task: joins may be split, aggregates are partial.
    """
    now = workspace.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        inner = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        if not inner and not now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            break
        old, now = now, workspace.stage(_small_star(_large_star(now)), "cc")
        workspace.drop(old)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
