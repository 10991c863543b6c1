"""Location models: transition frequencies, centres, distance kernels, smoothed priors."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import staging
from siftline.functions import math as M
from siftline.operators import retrieval as R


def transitions(history: DataFrame) -> DataFrame:
    """search_location_id, item_location_id, n, p = n / all of that search location."""
    counts = history.groupBy("search_location_id", "item_location_id").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("search_location_id")))


def log_geo(pairs: DataFrame, trans: DataFrame, floor: float = 1e-6, own: float = 0.5) -> DataFrame:
    """Adds log_geo: ln of the raw frequency, at least ``floor``, and at least ``own`` at the search's own location."""
    met = pairs.join(trans.select("search_location_id", "item_location_id", "p"), ["search_location_id", "item_location_id"], "left")
    p = F.coalesce("p", F.lit(floor))
    same = F.col("search_location_id") == F.col("item_location_id")
    return met.withColumn("log_geo", F.ln(F.when(same, F.greatest(p, F.lit(own))).otherwise(F.greatest(p, F.lit(floor))))).drop("p")


def log_prior(trans: DataFrame, floor: float = 1e-6, own: float = 0.5) -> DataFrame:
    """search_location_id, item_location_id, log_p: what ``log_geo`` gives for all pairs over the floor, own locations too."""
    own_rows = trans.select("search_location_id").distinct().select("search_location_id", F.col("search_location_id").alias("item_location_id"), F.lit(own).alias("p"))
    both = trans.select("search_location_id", "item_location_id", "p").unionByName(own_rows)
    best = both.groupBy("search_location_id", "item_location_id").agg(F.max("p").alias("p"))
    return best.where(F.col("p") > floor).select("search_location_id", "item_location_id", F.ln("p").alias("log_p"))


def rank_with_prior(scored: DataFrame | R.Lexical, queries: DataFrame, items: DataFrame, trans: DataFrame, alpha: float, k: int, floor: float = 1e-6, own: float = 0.5) -> DataFrame:
    """The k best items of every query by score + alpha * log_geo, over all items; an item without a match has score 0.

    ``scored``: query_id, item_id, score > 0 of all matches; ``queries``: query_id, search_location_id; ``items``:
    item_id, item_location_id. Beside the matches only these can be among the best: of each location over the floor
    (the search's own among them) the first k by id, and, of what is at the floor, the first k without a match.
    Of a ``Lexical`` that keeps item_location_id only the best k matches a task are made, not all, unless ids repeat.
    """
    lists = scored if isinstance(scored, R.Lexical) and not scored.ix.repeated else None
    scored = scored.pairs() if isinstance(scored, R.Lexical) and lists is None else scored
    asked = queries.select("query_id", "search_location_id")
    places = items.select("item_id", "item_location_id")
    searched = asked.select("search_location_id").distinct()
    trans = staging.stage(trans.select("search_location_id", "item_location_id", "p"), "transitions")  # the prior reads it twice, and it comes from the whole history
    known = log_prior(trans.unionByName(searched.select("search_location_id", F.col("search_location_id").alias("item_location_id"), F.lit(own).alias("p"))), floor, own)
    known = staging.stage(known, "prior")  # it is read several times
    first = Window.partitionBy("item_location_id").orderBy("item_id")
    few = places.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    near = searched.join(known, "search_location_id").join(few, "item_location_id")
    near = R.top_k(near.select(F.col("search_location_id").alias("query_id"), "item_id", "log_p", F.col("log_p").alias("score")), k).select(F.col("query_id").alias("search_location_id"), "item_id", "log_p")
    near = asked.join(near, "search_location_id").select("query_id", "item_id", F.lit(0.0).alias("score"), "log_p")
    if lists is not None:
        near = staging.stage(near, "near")
        held = replace(lists, ix=lists.ix.of(near)).pairs()
        # What lies near comes with its place's prior, so that no item is looked for once more.
        near = near.join(held, ["query_id", "item_id"], "left_anti").select("query_id", "item_id", (alpha * F.col("log_p")).alias("score"))
        best = lists.best(k, R.Bonus(known, asked, "item_location_id", alpha, floor)).select("query_id", "item_id", "score")
        ranked = staging.stage(R.top_k(best.unionByName(near), k), "ranked")  # fill reads it several times
        return R.fill(ranked, asked, items, k, alpha * math.log(floor))
    matches = scored.select("query_id", "item_id", "score")
    both = matches.unionByName(near.drop("log_p").join(matches, ["query_id", "item_id"], "left_anti"))
    score = F.round("score", 6) + alpha * F.coalesce("log_p", F.lit(math.log(floor)))
    met = both.join(asked, "query_id").join(places, "item_id").join(known, ["search_location_id", "item_location_id"], "left")
    ranked = staging.stage(R.top_k(met.select("query_id", "item_id", score.alias("score")), k), "ranked")
    return R.fill(ranked, asked, items, k, alpha * math.log(floor))


def centroids(points: DataFrame, key: str) -> DataFrame:
    """key, lat, lon: medians."""
    return points.groupBy(key).agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))


def spreads(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """key, d50, d75, d90: quantiles of the distances to the centre, each by the nearest of the sorted distances.

    Rows are counted by distinct rounded distance before they are sorted, so a place's many rows are never together."""
    met = points.join(centres.select(key, F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), key)
    d = F.round(M.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")), 6)
    counts = met.withColumn("d", d).where("d is not null").groupBy(key, "d").agg(F.count("*").alias("c"))
    counts = counts.select("*", F.sum("c").over(Window.partitionBy(key).orderBy("d")).alias("upto"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.round((F.col("n") - 1) * q), F.col("d")))
    return counts.groupBy(key).agg(at(0.5).alias("d50"), at(0.75).alias("d75"), at(0.9).alias("d90"))


def location_kind(known: Column, in_corpus: Column, median_spread: Column) -> Column:
    """city (the corpus has items there), national (widely spread), region, or unknown."""
    return F.when(in_corpus, "city").when(~known, "unknown").when(median_spread >= 500, "national").otherwise("region")


def smoothed_prior(
    search: DataFrame, items: DataFrame, trans: DataFrame, m: float = 20.0, m_wide: float = 50.0, own: float = 0.8, tau: float = 60.0, eps: float = 0.1,
    gamma: float = 0.75, floor: float = 1e-7, region_scale: float = 2.0,
) -> DataFrame:
    """search_location_id, item_location_id, p, log_p, log_p_item, dist_km, n_trans.

    ``search``: search_location_id, kind, lat, lon, d75; ``items``: item_location_id, w (its items), lat, lon. Counts
    are mixed with a backing distribution: a distance kernel on w^gamma and the national one, for a city with the
    share ``own`` at itself; counts at locations outside the corpus stay in the denominator.
    """
    pairs = search.withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"}).crossJoin(items)  # locations times locations: the table's own size
    pairs = pairs.join(trans.select("search_location_id", "item_location_id", F.col("n").alias("n_trans")), ["search_location_id", "item_location_id"], "left")
    totals = trans.groupBy("search_location_id").agg(F.sum("n").alias("n_all"))
    pairs = pairs.join(totals, "search_location_id", "left").fillna(0, ["n_trans", "n_all"])
    by_search = Window.partitionBy("search_location_id")
    city, same = F.col("kind") == "city", F.col("search_location_id") == F.col("item_location_id")
    pairs = pairs.withColumn("dist_km", M.haversine_km(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")))
    size = F.pow(F.col("w").cast("double"), F.lit(gamma))
    pairs = pairs.withColumn("nat", size / F.sum(size).over(by_search))
    scale = F.when(city, F.lit(tau)).otherwise(F.greatest(F.lit(tau), F.col("d75") * region_scale))
    pairs = pairs.withColumn("k0", F.when(city & same, 0.0).otherwise(size * F.exp(-F.col("dist_km") / scale)))
    total = F.sum("k0").over(by_search)
    pairs = pairs.withColumn("k", F.when(total > 0, F.col("k0") / total).otherwise(F.col("nat")))
    back = (1 - eps) * F.col("k") + eps * F.col("nat")
    back = F.when(F.col("kind") == "unknown", F.col("nat")).when(city, (1 - own) * back + F.when(same, own).otherwise(0.0)).otherwise(back)
    strength = F.when(city, F.lit(m)).otherwise(F.lit(m_wide))
    p = F.greatest((F.col("n_trans") + strength * back) / (F.col("n_all") + strength), F.lit(floor))
    out = pairs.withColumn("p", p)
    return out.select("search_location_id", "item_location_id", "kind", "p", F.ln("p").alias("log_p"), (F.ln("p") - F.ln(F.col("w").cast("double"))).alias("log_p_item"), "dist_km", "n_trans", F.col("w").alias("n_items_loc"), "k", "nat")


def modal_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the least of equally frequent ones."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, value, "n")
