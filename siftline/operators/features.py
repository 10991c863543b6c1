"""Features of (query, item) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.functions import text as T

MISSING_SCORE, MISSING_RANK = -100.0, 2001
GEO2_MISSING = {"geo2_logp": -16.12, "geo2_logp_item": -20.0, "geo2_nloc": 1.0, "geo2_km": 1000.0, "geo2_ntrans": 0.0}


def channel_features(pool: DataFrame, n_channels: int) -> DataFrame:
    """Scores and ranks filled where a channel lacks the pair, and each score's gap to the query's best in the pool."""
    by_query = Window.partitionBy("query_id")
    for j in range(n_channels):
        score = F.coalesce(F.col(f"c{j}_score"), F.lit(MISSING_SCORE))
        best = F.coalesce(F.max(f"c{j}_score").over(by_query), F.lit(MISSING_SCORE))
        pool = pool.withColumns({f"c{j}_score_gap": score - best, f"c{j}_rank": F.coalesce(F.col(f"c{j}_rank"), F.lit(MISSING_RANK))})
        pool = pool.withColumn(f"c{j}_score", score)
    return pool


def text_features(pairs: DataFrame) -> DataFrame:
    """Token overlap. The pairs have arrays q_tokens, q_filter_tokens, title_tokens, param_tokens, core_tokens,
    service_tokens, made once a query or item, and q_text and title."""
    c = F.col
    return pairs.withColumns(
        {
            "title_cov": M.coverage(c("q_tokens"), c("title_tokens")), "params_cov": M.coverage(c("q_tokens"), c("param_tokens")),
            "title_jacc": M.jaccard(c("q_tokens"), c("title_tokens")), "filter_cov": M.coverage(c("q_filter_tokens"), c("param_tokens")),
            "exact_phrase_title": T.phrase_in(c("q_text"), c("title")), "core_cov": M.coverage(c("q_tokens"), c("core_tokens")),
            "service_cov": M.coverage(c("q_tokens"), c("service_tokens")),
        }
    )


def item_features(items: DataFrame) -> DataFrame:
    """Numeric attributes, read leniently and on a log scale."""
    c = F.col
    positive = lambda name, fill=0.0: F.log1p(F.greatest(T.safe_number(c(name), fill), F.lit(0.0)))
    return items.withColumns(
        {
            "log_reviews": positive("reviews"), "rating": T.safe_number(c("rating")), "log_price": positive("price"), "log_title_len": F.log1p(F.length(F.coalesce("title", F.lit("")))),
            "log_params_len": F.log1p(F.length(F.coalesce("params", F.lit("")))), "log_desc_len": F.log1p(F.length(F.coalesce("description", F.lit("")))),
            "phone_hidden": F.coalesce(c("phone_hidden").cast("int"), F.lit(0)), "message_forbidden": F.coalesce(c("message_forbidden").cast("int"), F.lit(0)),
        }
    )


def distance_feature(pairs: DataFrame) -> DataFrame:
    """log_km from q_lat, q_lon, lat, lon; 15 where either place is unknown."""
    km = M.haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    return pairs.withColumn("log_km", M.not_a_number_to(F.log1p(km), 15.0))


def geo2_features(pairs: DataFrame, geo: DataFrame) -> DataFrame:
    """The smoothed table's five values, with their own defaults."""
    named = geo.select("search_location_id", "item_location_id", F.col("log_p").alias("geo2_logp"), F.col("log_p_item").alias("geo2_logp_item"), F.col("n_items_loc").cast("double").alias("geo2_nloc"), F.col("dist_km").alias("geo2_km"), F.col("n_trans").cast("double").alias("geo2_ntrans"))
    met = pairs.join(named, ["search_location_id", "item_location_id"], "left")
    return met.withColumns({k: M.not_a_number_to(F.col(k), v) for k, v in GEO2_MISSING.items()})


def class_prior_features(pairs: DataFrame, prior: DataFrame) -> DataFrame:
    """A query's probability and rank of the item's class; 0 and 11 where the list lacks it."""
    met = pairs.join(prior.select("query_id", "microcat", F.col("p").alias("microcat_p"), F.col("rank").alias("microcat_rank")), ["query_id", "microcat"], "left")
    return met.withColumns({"microcat_p": F.coalesce("microcat_p", F.lit(0.0)), "microcat_rank": F.coalesce("microcat_rank", F.lit(11))})


def filter_match_features(pairs: DataFrame, parts: tuple[str, ...] = ("vid", "tip", "tip_auto")) -> DataFrame:
    return pairs.withColumns({f"{p}_filter_match": M.three_valued(F.col(f"f_{p}"), F.col(p)) for p in parts})


def codes(rows: DataFrame, value: str, code: str) -> DataFrame:
    """Numbers from 0 for the distinct values in sorted order."""
    distinct = rows.select(F.coalesce(F.col(value), F.lit("")).alias(value)).distinct()
    numbered = distinct.withColumn(code, F.row_number().over(Window.orderBy(value)) - 1)
    return rows.withColumn(value, F.coalesce(F.col(value), F.lit(""))).join(numbered, value, "left")
