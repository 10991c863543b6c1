"""Measuring answers, and statistics on the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.functions import text as T
from siftline.operators import evaluation as E
from siftline.operators import sampling as S
from siftline.plans.fusion import CHANNELS, text_channel
from siftline.plans.registry import items, mix, passages, query, table

QRELS = "qrels AS MATERIALIZED (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Items that hold a passage."""
    return E.holders(items(spark, sf), passages(spark, sf))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return E.answers(text_channel(spark, sf, E.K))


_RECALL = f"""{CHANNELS}, {QRELS}, rec AS MATERIALIZED (
  SELECT query_id, count(*) AS n_rel, sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END)::BIGINT AS n_hit, sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) / count(*) AS recall
  FROM qrels LEFT JOIN c0 USING (query_id, item_id) GROUP BY query_id
)"""


def per_query(spark: SparkSession, sf: str) -> DataFrame:
    predicted = E.answer_items(answers(spark, sf)).select("query_id", F.col("item_id").cast("long").alias("item_id"))
    return E.recall(qrels(spark, sf), predicted)


@query(f"WITH {CHANNELS} SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY rank) AS answer FROM c0 WHERE rank <= 50 GROUP BY query_id")
def ordered_answer_concat(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf)


@query(f"WITH {_RECALL} SELECT query_id, n_rel, n_hit, round(recall, 6) AS recall FROM rec")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return per_query(spark, sf).withColumn("recall", F.round("recall", 6))


@query(f"""
WITH {CHANNELS}, {QRELS}, h AS (SELECT query_id, count(*) AS n, {', '.join(f'sum(coalesce((rank <= {k})::INT, 0)) AS h{k}' for k in (1, 5, 20, 50, 100, 200))} FROM qrels LEFT JOIN c0 USING (query_id, item_id) GROUP BY query_id)
SELECT {', '.join(f'round(avg(h{k} / n), 6) AS recall_{k}' for k in (1, 5, 20, 50, 100, 200))}, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM c0 GROUP BY query_id)) AS mean_pool_size FROM h
""")
def pool_recall_curve(spark: SparkSession, sf: str) -> DataFrame:
    return E.recall_curve(qrels(spark, sf), text_channel(spark, sf), [1, 5, 20, 50, 100, 200])


_META = """meta AS (SELECT item_id AS query_id, CASE WHEN len(string_split(text, ' ')) >= 50 THEN '50+' ELSE 'less' END AS words, (item_id % 3)::VARCHAR AS loc_type, CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END AS has_filter FROM benchmark)"""


def meta(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("query_id")
    return passages(spark, sf).select(
        n, F.when(F.size(F.split("text", " ")) >= 50, "50+").otherwise("less").alias("words"), (n % 3).cast("string").alias("loc_type"), F.when(n % 2 == 0, "true").otherwise("false").alias("has_filter")
    )


_SEGMENTS = ("words", "loc_type", "has_filter", "n_rel_b")


@query(f"""
WITH {_RECALL}, {_META}, r AS (SELECT *, CASE WHEN n_rel >= 3 THEN '3+' ELSE n_rel::VARCHAR END AS n_rel_b FROM rec JOIN meta USING (query_id))
{' UNION ALL '.join(f"SELECT '{s}' AS segment, {s} AS value, round(avg(recall), 6) AS recall, count(*) AS n FROM r GROUP BY {s}" for s in _SEGMENTS)}
""")
def segment_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = per_query(spark, sf).join(meta(spark, sf), "query_id").withColumn("n_rel_b", T.relevant_bucket(F.col("n_rel")))
    return E.segments(rows, list(_SEGMENTS))


_SCORED = "scored AS (SELECT user_id AS query_id, event_id AS item_id, floor(value / 10) AS score FROM events)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.floor(F.col("value") / 10).cast("double").alias("score"))


@query(f"""
WITH {_SCORED} SELECT query_id, item_id, score, 1 + (SELECT count(*) FROM scored b WHERE b.query_id = a.query_id AND b.score > a.score) + ((SELECT count(*) FROM scored b WHERE b.query_id = a.query_id AND b.score = a.score) - 1) / 2.0 AS expected_rank FROM scored a
""")
def expected_rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    from siftline.operators.retrieval import expected_rank

    return expected_rank(scored(spark, sf))


@query(f"WITH {_SCORED} SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM scored")
def rank_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored(spark, sf).select("query_id", "item_id", F.row_number().over(order).alias("rank"))


@query("""
WITH a AS (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN 'short' ELSE substr(md5((c_custkey - c_custkey % 40 // 39)::VARCHAR), 1, 16) END AS query_id,
         list_transform(range(0, (c_custkey % 4)::BIGINT), lambda i: CASE WHEN c_custkey % 30 = 7 THEN 'BAD' WHEN c_custkey % 20 = 3 THEN substr(md5('7'), 1, 16) ELSE substr(md5((c_custkey + i)::VARCHAR), 1, 16) END) AS ids,
         row_number() OVER () AS nr FROM customer
), q AS (SELECT substr(md5(c_custkey::VARCHAR), 1, 16) AS query_id FROM customer WHERE c_custkey % 7 > 0), i AS (SELECT substr(md5(c_custkey::VARCHAR), 1, 16) AS id FROM customer),
n AS (
  SELECT sum((length(query_id) <> 16)::INT) AS query_id_length, sum((len(list_filter(ids, lambda x: NOT regexp_matches(x, '^[0-9a-f]{16}$'))) > 0)::INT) AS bad_ids, sum((len(ids) > 2)::INT) AS too_many,
         sum((len(ids) <> len(list_distinct(ids)))::INT) AS duplicated_ids, sum((len(ids) < 2)::INT) AS too_few, count(*) - count(DISTINCT query_id) AS duplicated_queries,
         (SELECT count(DISTINCT query_id) FROM a WHERE query_id NOT IN (SELECT query_id FROM q)) AS unknown_queries, (SELECT count(DISTINCT query_id) FROM q WHERE query_id NOT IN (SELECT query_id FROM a)) AS missing_queries,
         (SELECT count(DISTINCT nr) FROM (SELECT nr, unnest(ids) AS id FROM a) WHERE regexp_matches(id, '^[0-9a-f]{16}$') AND id NOT IN (SELECT id FROM i)) AS unknown_ids FROM a
)
SELECT rule, n::BIGINT AS n, CASE WHEN rule IN ('too_few') THEN 'warning' ELSE 'error' END AS severity
FROM (UNPIVOT n ON query_id_length, bad_ids, too_many, duplicated_ids, too_few, duplicated_queries, unknown_queries, missing_queries, unknown_ids INTO NAME rule VALUE n)
""")
def answer_validator(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of an answer table, on one with every fault; at most two ids."""
    n = F.col("c_custkey")
    hexed = lambda c: F.substring(F.md5(c.cast("string").cast("binary")), 1, 16)
    count = (n % 4).cast("int")
    one = lambda i: F.when(n % 30 == 7, "BAD").when(n % 20 == 3, hexed(F.lit(7))).otherwise(hexed(n + i))
    ids = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<string>"))
    customer = table(spark, sf, "customer")
    name = F.when(n % 50 == 0, "short").otherwise(hexed(n - F.floor(n % 40 / 39)))
    answer = customer.select(name.alias("query_id"), F.array_join(ids, " ").alias("answer"))
    queries = customer.where(n % 7 > 0).select(hexed(n).alias("query_id"))
    return E.check_answer(answer, queries, customer.select(hexed(n).alias("item_id")), k=2)


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_per_experiment(spark: SparkSession, sf: str) -> DataFrame:
    out = E.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


def _rake_sql(passes: int) -> str:
    """The fit as a chain of CTEs, row by row of cells, values in sorted order (the total changes with each)."""
    values = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    ctes = [
        "cells AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, 1.0::DOUBLE AS w FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)",
        *[f"t_{c} AS (SELECT {c} AS v, count(*) / sum(count(*)) OVER () AS t FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 5 < 3 GROUP BY {c})" for c in values],
    ]
    last, k = "cells", 0
    for _ in range(passes):
        for c, vs in values.items():
            for v in vs:
                k += 1
                ctes.append(
                    f"w{k} AS MATERIALIZED (SELECT o_orderstatus, o_orderpriority, n, CASE WHEN {c} = '{v}' AND t > 0 AND s > 0 THEN w * t * total / s ELSE w END AS w FROM {last}, "
                    f"(SELECT sum(w * n) FILTER ({c} = '{v}') AS s, sum(w * n) AS total FROM {last}), (SELECT coalesce(max(t), 0) AS t FROM t_{c} WHERE v = '{v}'))"
                )
                last = f"w{k}"
    return f"WITH {', '.join(ctes)} SELECT o_orderstatus, o_orderpriority, n, round(w / (SELECT sum(w * n) / sum(n) FROM {last}), 6) AS w FROM {last}"


@query()
def rake_weights(spark: SparkSession, sf: str) -> DataFrame:
    """50 passes; as SQL these would be a chain of 400 tables."""
    return _raked(spark, sf, 50)


@query(_rake_sql(3))
def rake_three_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The first passes of ``rake_weights``, for its SQL."""
    return _raked(spark, sf, 3)


def _raked(spark: SparkSession, sf: str, passes: int) -> DataFrame:
    orders = table(spark, sf, "orders")
    names = ["o_orderstatus", "o_orderpriority"]
    cells = orders.where("o_orderkey % 3 = 0").groupBy(*names).agg(F.count("*").alias("n"))
    target = orders.where("o_orderkey % 3 = 1 and o_custkey % 5 < 3")
    return E.rake(cells, target, names, passes).select(*names, "n", F.round("w", 6).alias("w"))


RESAMPLES = 2000


def _draws(value: str, source: str, resamples: int) -> str:
    return f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {source}_id) - 1 AS idx, {value} AS x FROM {source}),
n AS (SELECT count(*) AS n FROM v), d AS (SELECT rep, {mix('idx * 7919 + rep * 104729', 'rep')} % n AS idx FROM v, n, (SELECT unnest(range(1, {resamples + 1})) AS rep)),
m AS (SELECT rep, avg(x) AS m FROM d JOIN v USING (idx) GROUP BY rep)"""


def _ci_sql(resamples: int) -> str:
    return f"""
WITH item AS (SELECT item_id, item_id % 3 / 2.0 AS r FROM benchmark), {_draws('r', 'item', resamples)}
SELECT (SELECT round(avg(x), 6) FROM v) AS mean, (SELECT n FROM n) AS n, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m
"""


@query(_ci_sql(RESAMPLES))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = passages(spark, sf).select("query_id", ((F.col("query_id") % 3) / 2.0).alias("r"))
    rows = rows.withColumn("idx", F.row_number().over(Window.orderBy("query_id")) - 1)
    return E.bootstrap(rows, "r", RESAMPLES)


def _paired_sql(resamples: int) -> str:
    return f"""
WITH item AS (SELECT item_id, item_id % 3 / 2.0 - item_id % 4 / 3.0 AS r FROM benchmark), {_draws('r', 'item', resamples)}
SELECT (SELECT round(avg(x), 6) FROM v) AS mean, (SELECT n FROM n) AS n, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi,
       (SELECT count(*) FROM v WHERE x > 0) AS better, (SELECT count(*) FROM v WHERE x < 0) AS worse FROM m
"""


@query(_paired_sql(RESAMPLES))
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("query_id")
    a = passages(spark, sf).select(n, (n % 3 / 2.0).alias("b"))
    b = passages(spark, sf).select(n, (n % 4 / 3.0).alias("a"))
    rows = a.join(b, "query_id").withColumn("d", F.col("b") - F.col("a")).withColumn("idx", F.row_number().over(Window.orderBy("query_id")) - 1)
    signs = rows.agg(F.sum((F.col("d") > 0).cast("long")).alias("better"), F.sum((F.col("d") < 0).cast("long")).alias("worse"))
    return E.bootstrap(rows, "d", RESAMPLES).crossJoin(signs)  # each is one row


@query("""
WITH w AS (SELECT item_id, item_id % 3 / 2.0 AS r, 1 + item_id % 5 AS w FROM benchmark) SELECT round(avg(r), 6) AS mean, round(sum(w * r) / sum(w), 6) AS weighted, count(*) AS n FROM w
""")
def weighted_recall(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("query_id")
    rows = passages(spark, sf).select((n % 3 / 2.0).alias("r"), (1 + n % 5).alias("w"))
    return rows.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.sum(F.col("w") * F.col("r")) / F.sum("w"), 6).alias("weighted"), F.count("*").alias("n"))


@query("""
SELECT event_type, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(*) AS n FROM events GROUP BY event_type
""")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"), "n")


@query("""
WITH p AS (SELECT lang, doc_id AS item_id, source FROM documents), k AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM p GROUP BY source),
v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM p GROUP BY ALL))
SELECT source, k.n, langs, lang AS top_lang, v.n AS top_n FROM k JOIN v USING (source) WHERE r = 1
""")
def parse_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """How many values each key has, and its most frequent ones."""
    from siftline.operators.geo import modal_value

    p = items(spark, sf).select("source", "lang")
    counts = p.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))
    return counts.join(modal_value(p, "source", "lang").select("source", F.col("lang").alias("top_lang"), F.col("n").alias("top_n")), "source")


_ALPHAS = (0.0, 0.25, 0.5, 1.0, 2.0)


@query(f"""
WITH s AS (SELECT user_id AS query_id, event_id AS item_id, value / 100.0 AS text_score, ln(1 + event_id % 17) AS prior, event_id % 11 = 0 AS rel FROM events),
a AS (SELECT unnest([{', '.join(map(str, _ALPHAS))}])::DOUBLE AS alpha),
r AS (SELECT alpha, rel, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(text_score + alpha * prior, 6) DESC, item_id) AS rank FROM s, a)
SELECT alpha, round(sum((rank <= 5 AND rel)::INT) / sum(rel::INT), 6) AS recall FROM r GROUP BY alpha
""")
def alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 5 for each weight of the prior."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), e.alias("item_id"), (F.col("value") / 100.0).alias("text_score"), F.log1p((e % 17).cast("double")).alias("prior"), (e % 11 == 0).alias("rel"))
    swept = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, _ALPHAS))))
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc(F.round(F.col("text_score") + F.col("alpha") * F.col("prior"), 6)), "item_id")
    ranked = swept.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("alpha").agg(F.round(F.sum(((F.col("rank") <= 5) & F.col("rel")).cast("long")) / F.sum(F.col("rel").cast("long")), 6).alias("recall"))


@query(f"""
WITH c AS (SELECT user_id AS query_id, event_id AS item_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS rank, (event_id % 11 = 0)::INT AS label FROM events)
SELECT query_id, item_id, label, rank FROM c WHERE label = 1 OR rank <= 4 OR {mix('query_id * 31 + item_id')} % 7 = 0
""")
def negative_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return S.negatives(_ranked_events(spark, sf), top=4)


def _ranked_events(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id"), e.alias("item_id"), F.row_number().over(order).alias("rank"), (e % 11 == 0).cast("int").alias("label"))


@query("""
WITH p AS (SELECT user_id AS query_id, event_id AS item_id, (event_id % 11 = 0)::INT AS label FROM events), q AS (SELECT query_id, count(*) AS n_rel FROM p WHERE label = 1 GROUP BY 1)
SELECT query_id, item_id, label, round(CASE WHEN label = 1 THEN 60.0 / n_rel ELSE 1.0 END, 6)::DOUBLE AS weight FROM p LEFT JOIN q USING (query_id)
""")
def sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _ranked_events(spark, sf)
    out = S.sample_weights(pairs, pairs.where("label = 1"))
    return out.select("query_id", "item_id", "label", F.round("weight", 6).alias("weight"))


@query("""
SELECT p_partkey, round((a + b) / 2, 6) AS score FROM (SELECT p_partkey, p_size / 50.0 AS a, p_retailprice / 2000.0 AS b FROM part)
""")
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0
    return table(spark, sf, "part").select("p_partkey", F.round((a + b) / 2, 6).alias("score"))


@query("""
SELECT c_custkey, CASE WHEN isnan(x) OR x IS NULL THEN 15.0 ELSE x END AS filled FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_acctbal END AS x FROM customer)
""")
def nan_defaults(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    x = F.when(n % 3 == 0, F.lit(float("nan"))).when(n % 3 == 1, F.lit(None)).otherwise(F.col("c_acctbal"))
    return table(spark, sf, "customer").select(n, M.not_a_number_to(x, 15.0).alias("filled"))
