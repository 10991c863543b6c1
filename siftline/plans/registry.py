"""Where queries register, and the roles that the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A scan of fewer partitions than there are cores (a small file of one row group) is dealt out to all of them
    before the costly work on its rows, or to ``parts``; a large table, which has more, is left as it is."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus items: documents, their first 120 characters as titles."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select(F.col("doc_id").alias("item_id"), "text", F.substring("text", 1, 120).alias("title"), "lang", "source", "n_chars")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def with_terms(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("terms", T.tokens(F.col(column)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions: the customer's nation searches, the supplier's nation is chosen."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("search_location_id"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("item_location_id"))
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(orders.join(customer, orders.o_custkey == customer.c_custkey), line.l_orderkey == orders.o_orderkey)
        .select("search_location_id", "item_location_id")
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with made-up coordinates."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        n.alias("location"), F.col("n_regionkey").cast("long").alias("region"), (F.pmod(n * 37, F.lit(120)) - 60).cast("double").alias("lat"), (F.pmod(n * 53, F.lit(340)) - 170).cast("double").alias("lon")
    )


# --- the same roles in SQL ------------------------------------------------------------------------------------------
def tok(x: str) -> str:
    return f"regexp_extract_all(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[a-zа-я0-9]+')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def mix(x: str, rep: str = "0", seed: int = 0) -> str:
    return f"(((({x}) % 1048576 + 1048576) % 1048576 * 1103515 + ({rep}) * 12345 + {seed}) % 2147483647)"


HISTORY = """history AS (
  SELECT c_nationkey::BIGINT AS search_location_id, s_nationkey::BIGINT AS item_location_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), trans AS (
  SELECT *, n / sum(n) OVER (PARTITION BY search_location_id) AS p FROM (SELECT search_location_id, item_location_id, count(*) AS n FROM history GROUP BY ALL)
)"""
PLACES = """places AS (
  SELECT n_nationkey::BIGINT AS location, n_regionkey::BIGINT AS region, (n_nationkey * 37 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 53 % 340 - 170)::DOUBLE AS lon FROM nation
)"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"12742.0 * asin(sqrt(least(greatest({h}, 0), 1)))"


def bm25_sql(name: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs that end in {name} (query_id, item_id, score)."""
    return f"""{name}_d AS MATERIALIZED (SELECT doc_id AS item_id, {tok(text)} AS toks FROM documents),
{name}_n AS MATERIALIZED (SELECT count(*) AS n, avg(len(toks)::DOUBLE) AS avgdl FROM {name}_d),
{name}_q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark),
{name}_tf AS MATERIALIZED (
  SELECT item_id, dl, term, count(*) AS tf FROM (SELECT item_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_d)
  WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL
), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_w AS (
  SELECT item_id, term, tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w
  FROM {name}_tf JOIN {name}_df USING (term), {name}_n
), {name} AS (SELECT query_id, item_id, round(sum(w), 6) AS score FROM {name}_q JOIN {name}_w USING (term) GROUP BY ALL)"""


def ranked_sql(name: str, source: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * FROM (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM {source}) WHERE rank <= {k}
)"""
