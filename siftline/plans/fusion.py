"""Channels to pool."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import staging
from siftline.functions import text as T
from siftline.operators import fusion as U
from siftline.operators import retrieval as R
from siftline.plans.registry import bm25_sql, items, passages, query, ranked_sql, with_terms


class Sizes(NamedTuple):
    depth: int  # ranks a channel keeps
    quotas: list[int]  # ranks of each channel that enter the union
    most: int  # pairs of a query after the cap


#: What a pool takes in production.
SIZES = Sizes(2000, [1000, U.dynamic_quota(2)], 2000)


def channels_sql(n: Sizes) -> str:
    return f"""{bm25_sql('s0')}, {ranked_sql('c0', 's0', n.depth)}, {bm25_sql('s1', "substr(text, 1, 120)")}, {ranked_sql('c1', 's1', n.depth)}"""


def pool_sql(n: Sizes) -> str:
    return f"""{channels_sql(n)}, keys AS (SELECT query_id, item_id FROM c0 WHERE rank <= {n.quotas[0]} UNION SELECT query_id, item_id FROM c1 WHERE rank <= {n.quotas[1]}),
pool AS MATERIALIZED (
  SELECT query_id, item_id, c0.score AS c0_score, c0.rank AS c0_rank, c1.score AS c1_score, c1.rank AS c1_rank,
         round(1.0 / (60 + coalesce(c0.rank, 2001)) + 1.0 / (60 + coalesce(c1.rank, 2001)), 9) AS rrf
  FROM keys LEFT JOIN c0 USING (query_id, item_id) LEFT JOIN c1 USING (query_id, item_id)
), capped AS MATERIALIZED (
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_id))::INT AS pool_rank FROM pool) WHERE pool_rank <= {n.most}
)"""


CHANNELS, POOL = channels_sql(SIZES), pool_sql(SIZES)


def channels(spark: SparkSession, sf: str, n: Sizes = SIZES) -> list[DataFrame]:
    """Texts and titles by BM25, from one index of both; each list is written, as the pool reads it several times."""
    ix = R.index(items(spark, sf).select("item_id", "text", "title"), with_terms(passages(spark, sf)), ["text", "title"])
    return [staging.stage(R.bm25_scores(ix.only(c)).best(n.depth), f"channel-{c}") for c in ix.fields]


def text_channel(spark: SparkSession, sf: str, depth: int = SIZES.depth) -> DataFrame:
    """The first of the channels alone, to a depth."""
    ix = R.index(items(spark, sf).select("item_id", "text"), with_terms(passages(spark, sf)), ["text"])
    return staging.stage(R.bm25_scores(ix).best(depth), "channel-text")


def union(spark: SparkSession, sf: str) -> DataFrame:
    return U.pool_union(channels(spark, sf), SIZES.quotas)


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return U.cap(U.fuse(union(spark, sf), 2), SIZES.most)


@query(f"WITH {POOL} SELECT query_id, item_id, c0_score, c0_rank, c1_score, c1_rank FROM pool")
def pool_union_quota(spark: SparkSession, sf: str) -> DataFrame:
    return union(spark, sf)


@query(f"WITH {POOL} SELECT query_id, item_id, rrf FROM pool")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return U.fuse(union(spark, sf), 2).select("query_id", "item_id", "rrf")


@query(f"WITH {POOL} SELECT query_id, item_id, rrf, pool_rank FROM capped")
def pool_cap(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).select("query_id", "item_id", "rrf", "pool_rank")


@query("""
WITH c AS (SELECT user_id AS query_id, floor(value * 10)::BIGINT AS item_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - (user_id % 9 = 0)::INT)::INT AS rank FROM events),
q AS (SELECT count(*) FILTER (n > 12)::BIGINT AS too_long, count(*) FILTER (least <> 1)::BIGINT AS not_from_one FROM (SELECT query_id, count(*) AS n, min(rank) AS least FROM c GROUP BY 1)),
p AS (SELECT count(*)::BIGINT AS repeated FROM (SELECT query_id, item_id FROM c GROUP BY ALL HAVING count(*) > 1))
SELECT too_long, not_from_one, repeated, (SELECT count(*) FROM c WHERE query_id NOT IN (SELECT c_custkey FROM customer)) AS unknown_queries,
       (SELECT count(*) FROM c WHERE item_id NOT IN (SELECT doc_id FROM documents)) AS unknown_items FROM q, p
""")
def channel_contract(spark: SparkSession, sf: str) -> DataFrame:
    """How often a (deliberately broken) channel breaks its contract."""
    from pyspark.sql import Window

    from siftline.plans.registry import table

    order = Window.partitionBy("user_id").orderBy("event_id")
    c = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.floor(F.col("value") * 10).cast("long").alias("item_id"), (F.row_number().over(order) - (F.col("user_id") % 9 == 0).cast("int")).alias("rank"))
    return U.contract(c, table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id")), items(spark, sf).select("item_id"), 12)
