"""Channels joined to one pool of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import math as M

PAIR = ["query_id", "item_id"]


def dynamic_quota(n_channels: int, most: int = 350, least: int = 100, total: int = 1500) -> int:
    """What each channel after the first may put into the pool."""
    return min(most, max(least, total // max(1, n_channels - 1)))


def pool_union(channels: list[DataFrame], quotas: list[int]) -> DataFrame:
    """Pairs that any channel ranks within its quota, with score and rank of every channel (from the whole channel)."""
    keys = None
    for channel, quota in zip(channels, quotas):
        part = channel.where(F.col("rank") <= quota).select(*PAIR)
        keys = part if keys is None else keys.unionByName(part)
    pool = keys.distinct()
    for j, channel in enumerate(channels):
        pool = pool.join(channel.select(*PAIR, F.col("score").alias(f"c{j}_score"), F.col("rank").alias(f"c{j}_rank")), PAIR, "left")
    return pool


def fuse(pool: DataFrame, n_channels: int, k: int = 60, missing: int = 2001) -> DataFrame:
    return pool.withColumn("rrf", F.round(M.rrf([F.col(f"c{j}_rank") for j in range(n_channels)], k, missing), 9))


def cap(fused: DataFrame, most: int = 2000) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "item_id")
    return fused.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= most)


def contract(channel: DataFrame, queries: DataFrame, items: DataFrame, most: int = 2000) -> DataFrame:
    """One row of counts of what breaks a channel's contract; all are 0 in a valid one."""
    by_query = channel.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("last"))
    by_pair = channel.groupBy(*PAIR).agg(F.count("*").alias("n"))
    sums = by_query.agg(
        F.coalesce(F.sum((F.col("n") > most).cast("long")), F.lit(0)).alias("too_long"), F.coalesce(F.sum((F.col("least") != 1).cast("long")), F.lit(0)).alias("not_from_one")
    )
    repeated = by_pair.agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated"))
    strange_q = channel.join(queries, "query_id", "left_anti").agg(F.count("*").alias("unknown_queries"))
    strange_i = channel.join(items, "item_id", "left_anti").agg(F.count("*").alias("unknown_items"))
    return sums.crossJoin(repeated).crossJoin(strange_q).crossJoin(strange_i)  # each is one row
