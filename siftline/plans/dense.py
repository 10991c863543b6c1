"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.operators import geo as G
from siftline.operators import retrieval as R
from siftline.plans.registry import query, ranked_sql, table

ALPHA = 0.005


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("q_label"))


_SCORES = """s AS MATERIALIZED (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS q_label, i.label AS label,
         round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings i WHERE q.vec_id % 10 = 0
)"""


@query(f"WITH {_SCORES}, {ranked_sql('r', 's', 50)} SELECT * FROM r")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest(_items(spark, sf), _queries(spark, sf), 50)


@query(f"""
WITH {_SCORES}, c AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label),
g AS (SELECT query_id, item_id, round(score + {ALPHA} * ln(CASE WHEN q_label = s.label THEN greatest(p, 0.5) ELSE greatest(p, 1e-6) END), 6) AS score FROM s JOIN c ON c.label = s.label),
{ranked_sql('r', 'g', 50)} SELECT * FROM r
""")
def cosine_geo_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors with the logarithm of a prior over the items' places (their labels), added to all of them."""
    corpus, qs = _items(spark, sf), _queries(spark, sf)
    share = corpus.groupBy("label").agg(F.count("*").alias("n")).crossJoin(corpus.agg(F.count("*").alias("total"))).select("label", (F.col("n") / F.col("total")).alias("p"))  # one row a label
    searched = qs.select(F.col("q_label").alias("search_location_id")).distinct()
    trans = searched.crossJoin(share.withColumnRenamed("label", "item_location_id"))  # labels times labels: the prior itself
    return R.nearest(corpus.withColumnRenamed("label", "item_location_id"), qs.withColumnRenamed("q_label", "search_location_id"), 50, G.log_prior(trans), ALPHA)


@query("""
SELECT label, count(*) AS n, sum((abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01)::INT)::BIGINT AS off,
       round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label
""")
def embedding_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    n = M.norm(F.col("embedding"))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum((F.abs(n - 1) > 0.01).cast("long")).alias("off"), F.round(F.avg(n), 6).alias("mean_norm"))


@query("""
SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of given pairs: here each vector and the next."""
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("y"))
    return a.join(b, F.col("item_id") == F.col("query_id") + 1).select("query_id", "item_id", F.round(M.dot(F.col("x"), F.col("y")), 6).alias("cosine"))
