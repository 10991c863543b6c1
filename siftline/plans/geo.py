"""Location models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.operators import geo as G
from siftline.plans.registry import HISTORY, PLACES, history, km, places, query, table


@query(f"WITH {HISTORY} SELECT search_location_id, item_location_id, n, round(p, 9) AS p FROM trans")
def transition_prior(spark: SparkSession, sf: str) -> DataFrame:
    return G.transitions(history(spark, sf)).withColumn("p", F.round("p", 9))


@query(f"""
WITH {HISTORY}, {PLACES}
SELECT s.location AS search_location_id, i.location AS item_location_id,
       round(ln(CASE WHEN s.location = i.location THEN greatest(coalesce(p, 1e-6), 0.5) ELSE greatest(coalesce(p, 1e-6), 1e-6) END), 6) AS log_geo
FROM places s CROSS JOIN places i LEFT JOIN trans ON search_location_id = s.location AND item_location_id = i.location
""")
def geo_log_floor(spark: SparkSession, sf: str) -> DataFrame:
    at = places(spark, sf).select("location")
    pairs = at.withColumnRenamed("location", "search_location_id").crossJoin(at.withColumnRenamed("location", "item_location_id"))  # the table itself is all pairs of places
    out = G.log_geo(pairs, G.transitions(history(spark, sf)))
    return out.select("search_location_id", "item_location_id", F.round("log_geo", 6).alias("log_geo"))


@query(f"""
WITH {PLACES}, c AS (SELECT region, median(lat) AS lat, median(lon) AS lon FROM places GROUP BY region),
d AS (SELECT region, list_sort(list(round({km('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6))) AS ds FROM places p JOIN c USING (region) GROUP BY region)
SELECT region, lat, lon, ds[(round((len(ds) - 1) * 0.5) + 1)::INT] AS d50, ds[(round((len(ds) - 1) * 0.75) + 1)::INT] AS d75, ds[(round((len(ds) - 1) * 0.9) + 1)::INT] AS d90
FROM c JOIN d USING (region)
""")
def geo_centroids(spark: SparkSession, sf: str) -> DataFrame:
    points = places(spark, sf)
    centres = G.centroids(points, "region")
    return centres.join(G.spreads(points, centres, "region"), "region")


@query(f"""
WITH {PLACES} SELECT a.location AS a, b.location AS b, round({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km, round(ln(1 + {km('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) AS log_km
FROM places a, places b
""")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = places(spark, sf)
    a = p.select(F.col("location").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = p.select(F.col("location").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = M.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.crossJoin(b).select("a", "b", F.round(d, 6).alias("km"), F.round(F.log1p(d), 6).alias("log_km"))  # the table itself is all pairs of places


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    points = places(spark, sf)
    n = F.col("location")
    search = points.select(n.alias("search_location_id"), F.when(n % 7 == 3, "unknown").when(n % 5 == 4, "region").otherwise("city").alias("kind"), "lat", "lon", (n * 10.0).alias("d75"))
    have = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("location")).agg(F.count("*").alias("w"))
    corpus = points.join(have, "location").select(n.alias("item_location_id"), "w", "lat", "lon")
    return G.smoothed_prior(search, corpus, G.transitions(history(spark, sf)))


_PRIOR = f"""{HISTORY}, {PLACES},
search AS (SELECT location AS s, CASE WHEN location % 7 = 3 THEN 'unknown' WHEN location % 5 = 4 THEN 'region' ELSE 'city' END AS kind, lat AS s_lat, lon AS s_lon, location * 10.0 AS d75 FROM places),
corpus AS (SELECT location AS i, w, lat, lon FROM places JOIN (SELECT s_nationkey AS location, count(*) AS w FROM supplier GROUP BY 1) USING (location)),
a AS (
  SELECT s, i, kind, w, d75, {km('s_lat', 's_lon', 'lat', 'lon')} AS dist_km, coalesce(t.n, 0) AS n_trans, coalesce(x.n_all, 0) AS n_all, pow(w::DOUBLE, 0.75) AS size
  FROM search CROSS JOIN corpus LEFT JOIN trans t ON t.search_location_id = s AND t.item_location_id = i
  LEFT JOIN (SELECT search_location_id, sum(n)::BIGINT AS n_all FROM trans GROUP BY 1) x ON x.search_location_id = s
), b AS (
  SELECT *, size / sum(size) OVER (PARTITION BY s) AS nat,
         CASE WHEN kind = 'city' AND s = i THEN 0.0 ELSE size * exp(-dist_km / CASE WHEN kind = 'city' THEN 60.0 ELSE greatest(60.0, d75 * 2.0) END) END AS k0 FROM a
), c AS (SELECT *, CASE WHEN sum(k0) OVER (PARTITION BY s) > 0 THEN k0 / sum(k0) OVER (PARTITION BY s) ELSE nat END AS k FROM b),
d AS (
  SELECT *, CASE kind WHEN 'unknown' THEN nat WHEN 'city' THEN (1 - 0.8::DOUBLE) * ((1 - 0.1::DOUBLE) * k + 0.1 * nat) + CASE WHEN s = i THEN 0.8 ELSE 0.0 END ELSE (1 - 0.1::DOUBLE) * k + 0.1 * nat END AS back,
         CASE kind WHEN 'city' THEN 20.0::DOUBLE ELSE 50.0::DOUBLE END AS m FROM c
), e AS (SELECT *, greatest((n_trans + m * back) / (n_all + m), 1e-7) AS p FROM d)"""


@query(f"WITH {_PRIOR} SELECT s AS search_location_id, i AS item_location_id, kind, round(k, 6) AS k, round(nat, 6) AS nat FROM e")
def geo_kernel_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf).select("search_location_id", "item_location_id", "kind", F.round("k", 6).alias("k"), F.round("nat", 6).alias("nat"))


@query(f"WITH {_PRIOR} SELECT s AS search_location_id, i AS item_location_id, kind, round(p, 6) AS p, round(ln(p), 6) AS log_p, round(dist_km, 6) AS dist_km, n_trans FROM e")
def geo_smoothed_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf).select("search_location_id", "item_location_id", "kind", F.round("p", 6).alias("p"), F.round("log_p", 6).alias("log_p"), F.round("dist_km", 6).alias("dist_km"), "n_trans")


@query(f"WITH {_PRIOR} SELECT s AS search_location_id, i AS item_location_id, round(ln(p) - ln(w::DOUBLE), 6) AS log_p_item, w AS n_items_loc FROM e")
def geo_item_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf).select("search_location_id", "item_location_id", F.round("log_p_item", 6).alias("log_p_item"), "n_items_loc")


@query(f"""
WITH {PLACES}, c AS (SELECT region, median(lat) AS lat, median(lon) AS lon FROM places GROUP BY region),
d AS (SELECT region, list_sort(list(round({km('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6))) AS ds FROM places p JOIN c USING (region) GROUP BY region)
SELECT location, CASE WHEN location IN (SELECT s_nationkey FROM supplier) THEN 'city' WHEN location % 6 = 5 THEN 'unknown' WHEN ds[(round((len(ds) - 1) * 0.5) + 1)::INT] >= 500 THEN 'national' ELSE 'region' END AS kind
FROM places JOIN d USING (region)
""")
def location_kind(spark: SparkSession, sf: str) -> DataFrame:
    points = places(spark, sf)
    spread = G.spreads(points, G.centroids(points, "region"), "region")
    have = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("location"), F.lit(True).alias("here")).distinct()
    rows = points.join(spread, "region").join(have, "location", "left")
    return rows.select("location", G.location_kind(F.col("location") % 6 != 5, F.coalesce("here", F.lit(False)), F.col("d50")).alias("kind"))


@query("""
WITH v AS (SELECT c_nationkey AS location, c_mktsegment AS name, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY ALL)
SELECT location, name, n FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, name) AS r FROM v) WHERE r = 1
""")
def city_mode_by_location(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("location"), F.col("c_mktsegment").alias("name"))
    return G.modal_value(rows, "location", "name")
