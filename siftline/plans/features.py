"""Pair features, and the answer from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import staging
from siftline.functions import math as M
from siftline.functions import text as T
from siftline.operators import evaluation as E
from siftline.operators import features as X
from siftline.operators import retrieval as R
from siftline.plans.fusion import POOL, pool
from siftline.plans.registry import items, passages, query, ranked_sql, spread, table, tok

PLACE = "CASE {x} % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END"


def _place(c):
    return F.when(c % 4 == 0, "de").when(c % 4 == 1, "en").when(c % 4 == 2, "es").otherwise("fr")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pool pairs with what both sides bring: token sets are made once a query and once an item of the pool, before the join.

    The pool's ids are sent to all tasks, so that whole texts aren't shuffled to find them."""
    pairs = staging.stage(pool(spark, sf), "pool")
    pooled = staging.stage(pairs.select("item_id").distinct(), "pool-items")
    q = passages(spark, sf).select("query_id", T.token_set(F.col("text")).alias("q_tokens"), F.substring("text", 1, 12).alias("q_text"), _place(F.col("query_id")).alias("q_place"), T.n_words(F.col("text")).alias("query_words"))
    q = q.withColumn("q_filter_tokens", F.slice("q_tokens", 1, 3))
    head = items(spark, sf).select("item_id", "title", "lang", "source", "n_chars", T.char_slice(F.col("text"), 0, 600).alias("head"))
    i = head.join(staging.lookup(pooled, staging.SMALL_IDS), "item_id", "left_semi").select(
        "item_id", "title", "lang", "source", "n_chars", T.token_set(F.col("title")).alias("title_tokens"), T.token_set(F.col("head")).alias("param_tokens"),
        T.token_set(T.char_slice(F.col("head"), 0, 300)).alias("core_tokens"), T.token_set(T.char_slice(F.col("head"), 300, 600)).alias("service_tokens"),
    )
    return pairs.join(q, "query_id").join(i, "item_id")


_PAIRS = f"""{POOL},
pq AS MATERIALIZED (SELECT item_id AS query_id, list_distinct({tok('text')}) AS a, substr(text, 1, 12) AS q_text, {PLACE.format(x='item_id')} AS q_place,
       len(string_split(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')), ' '))::INT AS query_words, {tok('text')} AS raw FROM benchmark),
pf AS MATERIALIZED (SELECT *, list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda z: list_position(raw, z[1]) = z[2])[1:3], lambda z: z[1]) AS f FROM pq),
pi AS MATERIALIZED (SELECT doc_id AS item_id, lang, source, n_chars, substr(text, 1, 120) AS title, list_distinct({tok('substr(text, 1, 120)')}) AS t, list_distinct({tok('substr(text, 1, 600)')}) AS p,
       list_distinct({tok('substr(text, 1, 300)')}) AS core, list_distinct({tok('substr(text, 301, 300)')}) AS service FROM documents),
feat AS MATERIALIZED (
  SELECT query_id, item_id, len(list_intersect(a, t)) / len(a) AS title_cov, len(list_intersect(a, p)) / len(a) AS params_cov,
         len(list_intersect(a, t)) / greatest(1, len(list_distinct(list_concat(a, t)))) AS title_jacc, CASE WHEN len(f) > 0 THEN len(list_intersect(f, p)) / len(f) ELSE 0 END AS filter_cov,
         len(list_intersect(a, core)) / len(a) AS core_cov, len(list_intersect(a, service)) / len(a) AS service_cov,
         (contains(lower(title), trim(lower(q_text))) AND trim(q_text) <> '')::INT AS exact_phrase_title, (q_place = lang)::INT AS same_loc, query_words,
         round(ln(1 + n_chars), 6) AS log_chars, coalesce(c0_score, -100) AS c0_score, coalesce(c0_rank, 2001) AS c0_rank, coalesce(c1_score, -100) AS c1_score, coalesce(c1_rank, 2001) AS c1_rank,
         round(coalesce(c0_score, -100) - coalesce(max(c0_score) OVER (PARTITION BY query_id), -100), 6) AS c0_score_gap,
         round(coalesce(c1_score, -100) - coalesce(max(c1_score) OVER (PARTITION BY query_id), -100), 6) AS c1_score_gap
  FROM capped JOIN pf USING (query_id) JOIN pi USING (item_id)
)"""


@query(f"WITH {_PAIRS} SELECT query_id, item_id, round(title_cov, 6) AS title_cov, round(params_cov, 6) AS params_cov, round(title_jacc, 6) AS title_jacc, round(filter_cov, 6) AS filter_cov FROM feat")
def coverage_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    out = X.text_features(_pairs(spark, sf))
    return out.select("query_id", "item_id", *[F.round(c, 6).alias(c) for c in ("title_cov", "params_cov", "title_jacc", "filter_cov")])


@query(f"WITH {_PAIRS} SELECT query_id, item_id, exact_phrase_title FROM feat")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return X.text_features(_pairs(spark, sf)).select("query_id", "item_id", "exact_phrase_title")


@query(f"WITH {_PAIRS} SELECT query_id, item_id, c0_score, c0_score_gap, c0_rank, c1_score, c1_score_gap, c1_rank FROM feat")
def channel_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = X.channel_features(pool(spark, sf), 2)
    return out.select("query_id", "item_id", "c0_score", F.round("c0_score_gap", 6).alias("c0_score_gap"), "c0_rank", "c1_score", F.round("c1_score_gap", 6).alias("c1_score_gap"), "c1_rank")


@query("""
SELECT doc_id AS item_id, round(ln(1 + greatest(coalesce(try_cast(CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE doc_id::VARCHAR END AS DOUBLE), 0), 0)), 6) AS log_reviews, n_chars / 10.0 AS rating,
       round(ln(1 + n_chars), 6) AS log_price, round(ln(1 + length(substr(text, 1, 120))), 6) AS log_title_len, round(ln(1 + length(lang)), 6) AS log_params_len, round(ln(1 + length(text)), 6) AS log_desc_len,
       (doc_id % 2)::INT AS phone_hidden, 0 AS message_forbidden FROM documents
""")
def item_numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    rows = items(spark, sf).select(
        n, F.when(n % 9 == 0, "none").otherwise(n.cast("string")).alias("reviews"), (F.col("n_chars") / 10.0).cast("string").alias("rating"), F.col("n_chars").cast("string").alias("price"), "title",
        F.col("lang").alias("params"), F.col("text").alias("description"), (n % 2 == 1).alias("phone_hidden"), F.lit(None).cast("boolean").alias("message_forbidden"),
    )
    logs = ("log_reviews", "log_price", "log_title_len", "log_params_len", "log_desc_len")
    return X.item_features(rows).select("item_id", "rating", "phone_hidden", "message_forbidden", *[F.round(c, 6).alias(c) for c in logs])


@query("""
WITH k AS (SELECT DISTINCT lang FROM documents), c AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS code FROM k)
SELECT doc_id AS item_id, code, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN source = 'src' || (doc_id % 7) THEN 1 ELSE -1 END AS source_match FROM documents JOIN c USING (lang)
""")
def filter_match(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    rows = X.codes(items(spark, sf), "lang", "code")
    wanted = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("src"), (n % 7).cast("string")))
    return rows.select(n, "code", M.three_valued(wanted, F.col("source")).alias("source_match"))


FEATURES = ["title_cov", "params_cov", "title_jacc", "filter_cov", "core_cov", "service_cov", "exact_phrase_title", "same_loc", "query_words", "log_chars", "c0_score", "c0_rank", "c0_score_gap", "c1_score", "c1_rank", "c1_score_gap"]


def pair_frame(spark: SparkSession, sf: str) -> DataFrame:
    out = X.channel_features(X.text_features(_pairs(spark, sf)), 2)
    out = out.withColumns({"same_loc": (F.col("q_place") == F.col("lang")).cast("int"), "log_chars": F.log1p("n_chars")})
    exact = {"exact_phrase_title", "same_loc", "query_words", "c0_rank", "c1_rank"}
    return out.select("query_id", "item_id", *[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in FEATURES])


_FEATURES = ", ".join(c if c in ("exact_phrase_title", "same_loc", "query_words", "c0_rank", "c1_rank") else f"round({c}, 6) AS {c}" for c in FEATURES)


@query(f"WITH {_PAIRS} SELECT query_id, item_id, {_FEATURES} FROM feat")
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return pair_frame(spark, sf)


_LINEAR = {"title_cov": 1.0, "params_cov": 2.0, "core_cov": 0.5, "exact_phrase_title": 0.25, "same_loc": 0.125, "c0_score_gap": 0.0625, "c1_score_gap": 0.03125}


@query(f"""
WITH {_PAIRS}, f AS (SELECT query_id, item_id, {_FEATURES} FROM feat), s AS (SELECT query_id, item_id, round({' + '.join(f'{w} * {c}' for c, w in _LINEAR.items())}, 6) AS score FROM f),
{ranked_sql('r', 's', 50)}
SELECT item_id AS query_id, coalesce(answer, '') AS answer FROM benchmark LEFT JOIN (SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY rank) AS answer FROM r GROUP BY 1) a ON a.query_id = item_id
""")
def answer_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Channels, pool, features, a fixed linear score, and the answers of every query."""
    score = sum((F.col(c) * w for c, w in list(_LINEAR.items())[1:]), F.col("title_cov") * 1.0)
    ranked = R.top_k(pair_frame(spark, sf).select("query_id", "item_id", score.alias("score")), 50)
    return passages(spark, sf).select("query_id").join(E.answers(ranked), "query_id", "left").fillna("", ["answer"])


def labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pool pairs with label 1 where the item holds the whole passage."""
    held = E.holders(items(spark, sf), passages(spark, sf)).withColumn("label", F.lit(1))
    return pair_frame(spark, sf).join(held, ["query_id", "item_id"], "left").fillna(0, ["label"])


@query()
def gbt_rank_top50(spark: SparkSession, sf: str) -> DataFrame:
    """The trained ranker's answer: gradient-boosted trees of three seeds on weighted, sampled pairs."""
    from siftline.operators import ranker, sampling

    pairs = staging.stage(labelled_pairs(spark, sf), "ranker-pool")
    qrels = pairs.where("label = 1").select("query_id", "item_id")
    train = sampling.negatives(pairs.withColumn("rank", F.col("c0_rank")))
    train = sampling.sample_weights(train, qrels)
    models = ranker.fit(train, FEATURES, seeds=[1, 2, 3])
    return ranker.predict(spread(pairs), models, FEATURES)


@query("""
WITH t AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, o_orderpriority AS microcat FROM orders),
p AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY n DESC, microcat))::INT AS rank, n / sum(n) OVER (PARTITION BY query_id) AS p FROM (SELECT query_id, microcat, count(*) AS n FROM t WHERE item_id % 3 <> 0 GROUP BY ALL))
SELECT t.query_id, t.item_id, round(coalesce(p, 0.0), 6) AS microcat_p, coalesce(rank, 11)::INT AS microcat_rank FROM t LEFT JOIN p USING (query_id, microcat)
""")
def class_prior(spark: SparkSession, sf: str) -> DataFrame:
    """The probability and rank of an item's class for its query, learned from two thirds of the rows."""
    from pyspark.sql import Window

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("microcat"))
    counts = rows.where("item_id % 3 <> 0").groupBy("query_id", "microcat").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id")
    prior = counts.select("query_id", "microcat", F.row_number().over(w.orderBy(F.desc("n"), "microcat")).alias("rank"), (F.col("n") / F.sum("n").over(w)).alias("p"))
    return X.class_prior_features(rows, prior).select("query_id", "item_id", F.round("microcat_p", 6).alias("microcat_p"), "microcat_rank")


@query("""
WITH t AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, o_orderpriority AS microcat, o_totalprice::DOUBLE / 100000 AS score FROM orders),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY query_id) AS p FROM (SELECT query_id, microcat, count(*) AS n FROM t WHERE item_id % 3 <> 0 GROUP BY ALL))
SELECT t.query_id, t.item_id, round(score + 2.0 * ln(1 + coalesce(p, 0.0) / 0.001), 6) AS score FROM t LEFT JOIN p USING (query_id, microcat)
""")
def class_prior_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores plus 2 * log((p + 0.001) / 0.001) of the item's class for its query."""
    from pyspark.sql import Window

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("microcat"), (F.col("o_totalprice").cast("double") / 100000).alias("score"))
    counts = rows.where("item_id % 3 <> 0").groupBy("query_id", "microcat").agg(F.count("*").alias("n"))
    classes = counts.select("query_id", "microcat", (F.col("n") / F.sum("n").over(Window.partitionBy("query_id"))).alias("p"))
    return R.with_class_prior(rows, rows, classes, 2.0, 1e-3).select("query_id", "item_id", F.round("score", 6).alias("score"))
