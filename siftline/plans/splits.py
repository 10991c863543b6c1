"""Splits without leaks: searches, locations, histories, stratified selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import sampling as S
from siftline.plans.registry import HISTORY, history, items, mix, query, table

KEYS = ["search", "place"]
_TRAIN = "train AS (SELECT user_id % 50 AS search, event_type AS place, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 1500 END AS item_id, event_id, lower(event_type) || ' ' || user_id % 70 AS norm_q FROM events)"


def train(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        (u % 50).alias("search"), F.col("event_type").alias("place"), F.when(e % 13 != 0, e % 1500).alias("item_id"), e, F.concat_ws(" ", F.lower("event_type"), (u % 70).cast("string")).alias("norm_q")
    )


@query(f"""
WITH {_TRAIN} SELECT search, place, count(*) AS n_rows, coalesce(list_sort(list(DISTINCT item_id) FILTER (item_id IN (SELECT doc_id FROM documents))), []) AS rel FROM train GROUP BY ALL
""")
def searches_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return S.searches(train(spark, sf), KEYS, items(spark, sf).select("item_id"))


@query(f"""
WITH {HISTORY}, own AS (SELECT search_location_id AS location, avg((search_location_id = item_location_id)::INT::DOUBLE) AS self_rate FROM history GROUP BY 1),
have AS (SELECT s_nationkey::BIGINT AS location, count(*) AS n_items FROM supplier WHERE s_nationkey < 20 GROUP BY 1),
r AS (SELECT coalesce(o.location, h.location) AS location, coalesce(n_items, 0) AS n_items, coalesce(self_rate, 1.0) AS self_rate FROM own o FULL JOIN have h ON o.location = h.location)
SELECT location, n_items, round(self_rate, 6) AS self_rate, CASE WHEN location = 3 THEN 'wide_rus' WHEN self_rate < 0.03 OR n_items = 0 THEN 'wide_other' WHEN n_items >= 6 THEN 'city_L' WHEN n_items >= 4 THEN 'city_M' ELSE 'city_S' END AS loc_type FROM r
""")
def location_table(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").cast("long").alias("item_location_id"))
    out = S.location_table(history(spark, sf), corpus, {"3": "wide_rus"}, large=6, medium=4, self_least=0.03)
    return out.withColumn("self_rate", F.round("self_rate", 6))


def _history_sql(kept: str) -> str:
    return f"""
WITH {_TRAIN}, q AS (SELECT event_id, norm_q, search AS search_location_id FROM train WHERE event_id % 5 = 0), h AS (SELECT norm_q, search AS search_location_id FROM train WHERE {kept}),
t AS (SELECT norm_q, count(*) AS n FROM h GROUP BY 1), p AS (SELECT DISTINCT * FROM h)
SELECT event_id, coalesce(n, 0) AS text_rows_in_history, coalesce(n, 0) > 0 AS seen_text, p.norm_q IS NOT NULL AS seen_same_loc,
       CASE WHEN n IS NULL THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 8 THEN '4-8' WHEN n <= 30 THEN '9-30' ELSE '31+' END AS f_bucket
FROM q LEFT JOIN t USING (norm_q) LEFT JOIN p ON p.norm_q = q.norm_q AND p.search_location_id = q.search_location_id
"""


@query(_history_sql("event_id % 5 <> 0"))
def history_features(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the rows are queries, all others their history."""
    rows = train(spark, sf).withColumnRenamed("search", "search_location_id")
    out = S.history_features(rows.where("event_id % 5 = 0"), rows.where("event_id % 5 <> 0"))
    return out.select("event_id", "text_rows_in_history", "seen_text", "seen_same_loc", "f_bucket")


@query(f"""
WITH {_TRAIN}, taken AS (SELECT DISTINCT search, place FROM train WHERE event_id % 100 = 0)
SELECT event_id FROM train WHERE (search, place) NOT IN (SELECT (search, place) FROM taken) AND item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM train WHERE event_id % 50 = 7 AND item_id IS NOT NULL)
  AND norm_q NOT IN (SELECT norm_q FROM train WHERE event_id % 200 = 3)
""")
def hist_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    t = train(spark, sf)
    return S.without_leaks(t, t.where("event_id % 100 = 0"), t.where("event_id % 50 = 7"), t.where("event_id % 200 = 3"), KEYS).select("event_id")


@query(f"""
WITH {_TRAIN} SELECT norm_q, event_id FROM (SELECT *, row_number() OVER (PARTITION BY norm_q ORDER BY {mix('event_id', '0', 5)}, event_id) AS r FROM train) WHERE r = 1
""")
def first_per_text(spark: SparkSession, sf: str) -> DataFrame:
    from siftline.functions import math as M

    return S.first_per(train(spark, sf), "norm_q", [M.mix(F.col("event_id"), 0, 5), "event_id"]).select("norm_q", "event_id")


@query("""
WITH c AS (SELECT source || '/' || lang AS cell, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, 137 * size / sum(size) OVER () AS x FROM c),
r AS (SELECT cell, size, floor(x)::BIGINT AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, cell) AS r FROM e)
SELECT cell, size, base + (r <= 137 - (SELECT sum(base) FROM r))::INT AS k FROM r
""")
def strata_allocation(spark: SparkSession, sf: str) -> DataFrame:
    cells = items(spark, sf).groupBy(F.concat_ws("/", "source", "lang").alias("cell")).agg(F.count("*").alias("size"))
    return S.allocate(cells, 137)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.searches(train(spark, sf), ["search", "place", "norm_q"], items(spark, sf).select("item_id"))
    rows = rows.where("size(rel) between 1 and 6").withColumn("seen", F.size("rel"))
    n = F.xxhash64("search", "place", "norm_q")
    named = rows.select(F.row_number().over(Window.orderBy("search", "place", "norm_q")).cast("long").alias("id"), n.alias("h"), F.least(F.col("seen"), F.lit(3)).cast("string").alias("f"), "place", "rel", "seen")
    return S.shuffled(named, "id", 9)


@query()
def stratified_select(spark: SparkSession, sf: str) -> DataFrame:
    """Two splits of 30 searches each that share no item."""
    wanted = {s: [(("1", "click"), 10), (("2", "view"), 10), (("3", "purchase"), 10)] for s in ("val", "tst")}
    chosen = S.select_stratified(_candidates(spark, sf), ["f", "place"], wanted, seen="seen", convert="0")
    return S.split_ids(chosen, ["id"])
