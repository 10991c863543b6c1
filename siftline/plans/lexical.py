"""Text analysis and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import geo as G
from siftline.operators import retrieval as R
from siftline.plans.registry import HISTORY, bm25_sql, history, items, norm, passages, query, ranked_sql, table, tok, with_terms

FIELD_WEIGHTS = {"title": 2.0, "body": 1.0, "source": 1.0}
FIELD_BS = {"title": 0.9, "body": 0.75, "source": 0.75}


@query(f"""
SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, coalesce(t[1], '') AS first_token, array_to_string(t[1:5], ' ') AS head
FROM (SELECT doc_id, {tok('text')} AS t FROM documents)
""")
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.get("t", 0), F.lit("")).alias("first_token"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(f"""
WITH n AS (SELECT doc_id, {norm('substr(text, 1, 120)')} AS norm_title FROM documents)
SELECT norm_title, min(doc_id) AS first_id, count(*) AS n, len(string_split(norm_title, ' '))::INT AS n_words,
       CASE WHEN len(string_split(norm_title, ' ')) >= 5 THEN '5+' ELSE len(string_split(norm_title, ' '))::VARCHAR END AS words_bucket,
       CASE WHEN count(*) = 0 THEN '0' WHEN count(*) = 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' WHEN count(*) <= 8 THEN '4-8' WHEN count(*) <= 30 THEN '9-30' ELSE '31+' END AS f_bucket
FROM n GROUP BY norm_title
""")
def norm_text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf).select(T.norm_text(F.col("title")).alias("norm_title"), "item_id")
    out = rows.groupBy("norm_title").agg(F.min("item_id").alias("first_id"), F.count("*").alias("n"))
    n_words = F.size(F.split("norm_title", " "))
    return out.withColumns({"n_words": n_words, "words_bucket": T.words_bucket(n_words), "f_bucket": T.frequency_bucket(F.col("n"))})


def _texts(spark: SparkSession, sf: str, column: str = "text") -> DataFrame:
    """Items with the text that the index tokenizes, and their places: they lie in the 25 nations and six places that nobody chose."""
    return items(spark, sf).select("item_id", (F.col("item_id") % 31).alias("item_location_id"), F.col(column).alias("terms"))


@query(f"WITH {bm25_sql('s')}, {ranked_sql('r', 's', 50)} SELECT * FROM r")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_lists(_texts(spark, sf), with_terms(passages(spark, sf))).best(50)


_WEIGHTINGS = ((1.2, 0.75), (0.9, 0.4))


@query(f"""
WITH {bm25_sql('s0', 'text', *_WEIGHTINGS[0])}, {ranked_sql('r0', 's0', 10)}, {bm25_sql('s1', 'text', *_WEIGHTINGS[1])}, {ranked_sql('r1', 's1', 10)}
SELECT 0 AS weighting, * FROM r0 UNION ALL SELECT 1, * FROM r1
""")
def bm25_reweight(spark: SparkSession, sf: str) -> DataFrame:
    """One table of term frequencies, weighed in two ways."""
    ix = R.index(_texts(spark, sf), with_terms(passages(spark, sf)), ["terms"])
    ranked = [R.bm25_scores(ix, *w).best(10).select(F.lit(k).alias("weighting"), "query_id", "item_id", "score", "rank") for k, w in enumerate(_WEIGHTINGS)]
    return ranked[0].unionByName(ranked[1])


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    """Titles, bodies (by slices, so a word across a cut is two tokens) and sources, as texts, and places."""
    return items(spark, sf).select("item_id", (F.col("item_id") % 31).alias("item_location_id"), "title", R.body_text(F.col("text")).alias("body"), "source")


_BODY = f"list_concat({tok('substr(text, 1, 1500)')}, {tok('substr(text, 1501, 2500)')}, {tok('substr(text, 4001)')})"
_BM25F = f"""f AS MATERIALIZED (
  SELECT doc_id AS item_id, {tok('substr(text, 1, 120)')} AS title, {_BODY} AS body, {tok('source')} AS source FROM documents
), n AS MATERIALIZED (SELECT count(*) AS n, avg(len(title)::DOUBLE) AS a_title, avg(len(body)::DOUBLE) AS a_body, avg(len(source)::DOUBLE) AS a_source FROM f),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark),
tf AS (
  SELECT item_id, w, b, dl, avg_f, term, count(*) AS tf FROM (
    SELECT item_id, 2.0 AS w, 0.9 AS b, len(title) AS dl, a_title AS avg_f, unnest(title) AS term FROM f, n
    UNION ALL SELECT item_id, 1.0, 0.75, len(body), a_body, unnest(body) FROM f, n
    UNION ALL SELECT item_id, 1.0, 0.75, len(source), a_source, unnest(source) FROM f, n
  ) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), t AS MATERIALIZED (SELECT item_id, term, sum(w * tf / (1 - b + b * dl / greatest(avg_f, 1e-9))) AS t FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT query_id, item_id, round(sum(t * 2.2 / (t + 1.2) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM q JOIN t USING (term) JOIN df USING (term), n GROUP BY ALL)"""


@query(f"WITH {_BM25F}, {ranked_sql('r', 's', 50)} SELECT * FROM r")
def bm25f_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25f_lists(_fields(spark, sf), with_terms(passages(spark, sf)), FIELD_WEIGHTS, FIELD_BS).best(50)


#: All items and all queries, an item without a match with score 0, and the logarithm of how often a search there chose the item's place.
_GEO = """g AS (
  SELECT query_id, item_id, round(round(coalesce(s.score, 0), 6) + {alpha} * ln(CASE WHEN a = b THEN greatest(coalesce(p, 1e-6), 0.5) ELSE greatest(coalesce(p, 1e-6), 1e-6) END), 6) AS score
  FROM (SELECT item_id AS query_id, (item_id % 25)::BIGINT AS a FROM benchmark) CROSS JOIN (SELECT doc_id AS item_id, (doc_id % 31)::BIGINT AS b FROM documents)
  LEFT JOIN s USING (query_id, item_id) LEFT JOIN trans ON search_location_id = a AND item_location_id = b
)"""


def _with_places(spark: SparkSession, sf: str, scored: R.Lexical, alpha: float) -> DataFrame:
    """Items lie in the 25 nations and six places that nobody chose; queries search from a nation."""
    asked = passages(spark, sf).select("query_id", (F.col("query_id") % 25).alias("search_location_id"))
    places = items(spark, sf).select("item_id", (F.col("item_id") % 31).alias("item_location_id"))
    return G.rank_with_prior(scored, asked, places, G.transitions(history(spark, sf)), alpha, 50)


@query(f"WITH {bm25_sql('s')}, {HISTORY}, {_GEO.format(alpha=2.0)}, {ranked_sql('r', 'g', 50)} SELECT * FROM r")
def bm25_geo_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 with the prior of places, over all items."""
    return _with_places(spark, sf, R.bm25_lists(_texts(spark, sf), with_terms(passages(spark, sf)), ["item_location_id"]), 2.0)


@query(f"WITH {_BM25F}, {HISTORY}, {_GEO.format(alpha=1.5)}, {ranked_sql('r', 'g', 50)} SELECT * FROM r")
def bm25f_geo_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Fielded BM25 with the prior of places, over all items."""
    return _with_places(spark, sf, R.bm25f_lists(_fields(spark, sf), with_terms(passages(spark, sf)), FIELD_WEIGHTS, FIELD_BS, ["item_location_id"]), 1.5)


@query(f"""
WITH {bm25_sql('s', "substr(text, 1, 120)")}, {ranked_sql('c', 's', 60)},
tail AS (SELECT doc_id AS item_id FROM documents ORDER BY doc_id LIMIT 120),
have AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
short AS (SELECT item_id AS query_id FROM benchmark LEFT JOIN have ON query_id = item_id WHERE coalesce(n, 0) < 60),
extra AS (SELECT query_id, item_id, 0.0::DOUBLE AS score FROM (SELECT query_id, item_id FROM short, tail) ANTI JOIN c USING (query_id, item_id)),
u AS (SELECT query_id, item_id, score FROM c UNION ALL SELECT * FROM extra),
{ranked_sql('r', 'u', 60)} SELECT * FROM r
""")
def bm25_filled(spark: SparkSession, sf: str) -> DataFrame:
    """A full ranking's tail: queries with too few matches get unmatched items by id."""
    corpus, qs = _texts(spark, sf, "title"), with_terms(passages(spark, sf))
    return R.fill(R.bm25_lists(corpus, qs).best(60), qs, corpus, 60)


@query("""
SELECT doc_id, n_chars, length(text)::INT AS length, round(ln(1 + length(text)), 6) AS log_length, lower(substr(text, 1, 1)) = substr(text, 1, 1) AS starts_lower,
       trim(coalesce(text, '')) = '' AS blank, substr(sha256(text), 1, 16) AS short_hash, substr(text, 11, 20) AS middle, lpad(doc_id::VARCHAR, 13, '0') AS padded,
       starts_with(text, 'The') AS the
FROM documents
""")
def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.length(t).alias("length"), F.round(F.log1p(F.length(t)), 6).alias("log_length"), (F.lower(F.substring(t, 1, 1)) == F.substring(t, 1, 1)).alias("starts_lower"),
        T.is_blank(t).alias("blank"), T.short_hash(t).alias("short_hash"), T.char_slice(t, 10, 30).alias("middle"), F.lpad(F.col("doc_id").cast("string"), 13, "0").alias("padded"), t.startswith("The").alias("the"),
    )


@query(r"""
WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL ELSE event_id::VARCHAR || '.5' END AS raw FROM events)
SELECT event_id, coalesce(try_cast(raw AS DOUBLE), -1.0) AS number, round(ln(1 + greatest(coalesce(try_cast(raw AS DOUBLE), -1.0), 0)), 6) AS log_number,
       CASE WHEN event_id % 40 = 0 THEN '0' WHEN event_id % 40 <= 10 THEN '1-10' WHEN event_id % 40 <= 50 THEN '11-50' ELSE '51+' END AS reviews_bucket,
       CASE WHEN event_id % 5 >= 3 THEN '3+' ELSE (event_id % 5)::VARCHAR END AS relevant_bucket
FROM s
""")
def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "n/a").when(e % 7 == 0, F.lit(None)).otherwise(F.concat(e.cast("string"), F.lit(".5")))
    number = T.safe_number(F.col("raw"), -1.0)
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select(
        "event_id", number.alias("number"), F.round(F.log1p(F.greatest(number, F.lit(0.0))), 6).alias("log_number"), T.reviews_bucket(e % 40).alias("reviews_bucket"), T.relevant_bucket(e % 5).alias("relevant_bucket")
    )
