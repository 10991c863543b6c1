"""A whole split from raw rows: searches, eligible ones, stratified selection, history without leaks, metadata, manifest.

Evaluation sets are drawn like the bench in four strata and share no item; the ranker's training set is drawn from what
they leave. A search is the combination of ``KEY``; nulls count as values there. Only the greedy selection runs in one
task, over the first candidates of each cell; when it would need more than these, it is repeated with more.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import staging
from siftline.functions import text as T
from siftline.operators import sampling as S
from siftline.plans.registry import items, query, table
from siftline.sources.tables import Store, content_hash

# The keys, strata, names and prefixes of the tables' format.
KEY = ["search_query", "search_location_id", "search_infm_params_text", "search_category", "search_is_delivery_search"]
STRATA = ["loc_coarse", "f_bucket", "has_filter", "words_bucket"]
QUERY = ["query_id", "search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]
META = ["query_id", "loc_type", "loc_coarse", "f_bucket", "has_filter", "n_words", "words_bucket", "seen_text", "seen_same_loc", "text_rows_in_history", "n_items_at_loc", "search_category"]
NAMED = {"637640": "msk", "653240": "spb", "107620": "wide_msk", "107621": "wide_spb", "621540": "wide_rus"}
PREFIX = {"val": "val", "test": "tst", "rtrain": "rtr"}
SHARES = ["loc_coarse", "f_bucket", "has_filter", "words_bucket", "seen_text"]


@dataclasses.dataclass(frozen=True)
class Plan:
    """How many searches each split gets; the sets of one round take turns, the rounds follow each other."""

    rounds: tuple[dict[str, int], ...] = ({"val": 2000, "test": 2000}, {"rtrain": 6000})
    most_relevant: int = 5
    seed: int = 1
    per_cell: int = 1000


@dataclasses.dataclass(frozen=True)
class Split:
    """The tables of a split: queries, qrels and meta have a column split; meta has the bench too."""

    hist: DataFrame
    queries: DataFrame
    qrels: DataFrame
    meta: DataFrame
    manifest: dict


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"norm_q": T.norm_text(F.col("search_query")), "_search": F.to_json(F.struct(*KEY))})


def _described(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds the segment columns that hang on the search alone."""
    words = T.n_words(F.col("search_query"))
    named = locations.select(F.col("location").alias("search_location_id"), "loc_type", F.col("n_items").alias("n_items_at_loc"))
    coarse = F.when(F.col("loc_type").startswith("wide"), "wide").otherwise(F.col("loc_type"))
    out = rows.join(named, "search_location_id", "left").withColumn("loc_coarse", coarse)
    return out.withColumns({"has_filter": ~T.is_blank(F.col("search_infm_params_text")), "n_words": words, "words_bucket": T.words_bucket(words)})


def _cell() -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in STRATA]


def candidates(train: DataFrame, corpus: DataFrame, locations: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The eligible searches, and one of them for each text, drawn by a hash of the search."""
    texts = train.groupBy("norm_q").agg(F.count("*").alias("text_rows"))
    found = S.searches(train, [*KEY, "norm_q", "_search"], corpus)
    fit = found.where(F.size("rel").between(1, plan.most_relevant) & (F.col("search_is_delivery_search").cast("int") == 0) & (F.col("norm_q") != ""))
    fit = _described(fit, locations).join(texts, "norm_q").withColumn("seen", F.col("text_rows") - F.col("n_rows"))
    eligible = staging.stage(fit.withColumn("f_bucket", T.frequency_bucket(F.col("seen"))), "split-eligible")
    draw = F.struct(F.xxhash64(F.lit(plan.seed), "_search").alias("h"), "_search")
    row = F.struct(*KEY, "_search", "rel", "seen", "n_words", "loc_type", "n_items_at_loc", *_cell())
    first = eligible.groupBy(F.col("norm_q").alias("id")).agg(F.min_by(row, draw).alias("row"))
    position = F.xxhash64(F.lit(plan.seed), "row._search")
    return eligible, staging.stage(first.select("id", position.alias("position"), "row.*"), "split-candidates")


def _chosen(pool: DataFrame, cells: DataFrame, sizes: dict[str, int], plan: Plan) -> DataFrame:
    """id, split, converted for the sets of one round."""
    wanted = {s: [(tuple(r.cell), r.k) for r in S.allocate(cells, n).where("k > 0").collect()] for s, n in sizes.items()}  # cells of labels
    limit = plan.per_cell
    while True:
        few = S.likely(pool.select("id", "position", "rel", "seen", *STRATA), STRATA, limit, "seen", frequency="f_bucket")
        got = staging.stage(S.select_stratified(few, STRATA, wanted, "seen", frequency="f_bucket", limit=limit), "split-chosen")
        if got.where("split is null").isEmpty():
            return got
        staging.drop(got)
        limit *= 4


def build(train: DataFrame, corpus: DataFrame, bench: DataFrame, plan: Plan = Plan()) -> Split:  # noqa: B008
    """``train``: ``KEY``, item_id, item_location_id, train_row_id; ``corpus``: item_id, item_location_id,
    item_rating_reviews_count; ``bench``: ``QUERY``."""
    rows = _keyed(train)
    locations = staging.stage(S.location_table(train, corpus, NAMED), "split-locations")
    asked = _described(bench.withColumn("norm_q", T.norm_text(F.col("search_query"))), locations)
    bench_meta = staging.stage(S.history_features(asked, rows).select(*META, F.lit("bench").alias("split")), "split-bench")
    cells = bench_meta.select(F.array(*_cell()).alias("cell")).groupBy("cell").agg(F.count("*").alias("size"))
    eligible, pool = candidates(rows, corpus, locations, plan)

    left, parts = pool, []
    for sizes in plan.rounds:
        got = _chosen(left, cells, sizes, plan)
        parts.append(pool.join(staging.lookup(got), "id"))
        used = parts[-1].select(F.explode("rel").alias("item"))
        # An item's searches may be many, so it is the left side that is exploded.
        clash = left.select("id", F.explode("rel").alias("item")).join(used, "item", "left_semi").select("id")
        left = left.join(got.select("id").unionByName(clash).distinct(), "id", "left_anti")
    picked = parts[0]
    for more in parts[1:]:
        picked = picked.unionByName(more)
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    picked = picked.withColumns({"_name": F.coalesce(F.try_element_at(prefix, F.col("split")), F.col("split")), "norm_q": F.col("id")})
    picked = staging.stage(S.split_ids(picked, [F.xxhash64(F.lit(plan.seed + 1), "id"), "id"], split="_name"), "split-picked")

    searched, wanted = staging.lookup(picked.select("_search")), picked.select(F.explode("rel").alias("item_id")).distinct()
    other = staging.stage(rows.join(searched, "_search", "left_anti"), "split-other")
    remaining = other.where(F.col("item_id").isNotNull()).join(wanted, "item_id", "left_anti")
    hist = staging.stage(remaining.join(picked.where("converted").select("norm_q"), "norm_q", "left_anti").select(*rows.columns), "split-hist")

    reviews = corpus.select("item_id", F.coalesce("item_rating_reviews_count", F.lit(0)).alias("reviews"))
    least = picked.select("query_id", F.explode("rel").alias("item_id")).join(reviews, "item_id").groupBy("query_id").agg(F.min("reviews").alias("pos_reviews_min"))
    met = S.history_features(picked.drop("f_bucket"), hist).join(least, "query_id", "left").withColumns({"n_rel": F.size("rel"), "has_filter": F.col("has_filter").cast("boolean")})
    met = met.withColumn("loc_coarse", F.when(F.col("loc_type").isNotNull(), F.col("loc_coarse")))
    meta = met.select(*META, "split", "n_rel", "pos_reviews_min").unionByName(bench_meta, allowMissingColumns=True)
    meta = staging.stage(meta, "split-meta")
    queries = picked.select(*QUERY, "split")
    qrels = picked.select("query_id", F.explode("rel").alias("item_id"), "split")
    kept = hist.drop("norm_q", "_search")

    n_train, n_other, n_remaining, n_hist = rows.count(), other.count(), remaining.count(), hist.count()
    sets = {r.split: r for r in picked.groupBy("split").agg(F.count("*").alias("n"), F.count_if("converted").alias("c")).collect()}
    warm = corpus.select("item_id").distinct().join(hist.select("item_id", F.lit(1).alias("hit")).distinct(), "item_id", "left").agg(F.round(F.count("hit") / F.count("*"), 4)).first()[0]
    totals = {r.split: r.n for r in meta.groupBy("split").agg(F.count("*").alias("n")).collect()}
    shares: dict = {s: {} for s in totals}
    for c in SHARES:  # a few labels each
        for r in meta.groupBy("split", F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy("split", "v").collect():
            shares[r.split].setdefault(c, {})[str(r.v)] = round(r.n / totals[r.split], 4)
    hashes = {f"{s}_{name}": content_hash(df.where(F.col("split") == s)) for name, df in (("queries", queries), ("qrels", qrels), ("meta", meta)) for s in sorted(sets)}
    hashes |= {"bench_meta": content_hash(bench_meta), "hist_row_ids": content_hash(kept.select("train_row_id"))}
    manifest = {
        "seed": plan.seed, "max_rel": plan.most_relevant,
        "counts": {
            "train_rows": n_train, "hist_rows": n_hist, "eligible_searches": eligible.count(), "candidate_texts": pool.count(),
            **{s: r.n for s, r in sorted(sets.items())}, "converted_texts": sum(r.c for r in sets.values()),
        },
        "removed_rows": {"query_set_search_rows": n_train - n_other, "other_rows_with_query_set_items": n_other - n_remaining, "converted_text_rows": n_remaining - n_hist},
        "corpus_items_seen_in_hist": warm, "shares": shares, "hashes": hashes,
    }
    return Split(kept, queries, qrels, meta, manifest)


def build_in_store(store: Store, plan: Plan = Plan(), write: bool = True, force: bool = False) -> tuple[str, dict]:  # noqa: B008
    """Builds the split of a store and writes it there, the manifest last: what was done, and the manifest.

    If a manifest is there already, nothing is written: equal hashes verify it, others are an error unless ``force``.
    """
    spark, place = store.spark, f"{store.root}/manifest.json"
    corpus = store.corpus(["item_id", "item_location_id", "item_rating_reviews_count"])
    out = build(store.train_rows("bench"), corpus, store.queries("bench"), plan)
    if not write:
        return "not written", out.manifest
    if store._fs(place).exists(store._hadoop(place)):
        if json.loads(spark.read.text(place).first().value)["hashes"] == out.manifest["hashes"]:
            return "verified", out.manifest
        if not force:
            raise ValueError("the split that is there differs from this build; force replaces it")
        store._delete(place)
    out.hist.write.mode("overwrite").option("compression", "zstd").parquet(f"{store.root}/hist")
    for name, df in (("queries", out.queries), ("qrels", out.qrels), ("meta", out.meta)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").option("compression", "zstd").parquet(f"{store.root}/{name}")
    spark.createDataFrame([(json.dumps(out.manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(place)
    return "written", out.manifest


def _from_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as searches and choices among documents; customers as the bench."""
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    docs = items(spark, sf).groupBy("item_id").agg(F.max("n_chars").alias("n_chars"))
    total = docs.agg(F.count("*").alias("total"))
    corpus = docs.select("item_id", (F.col("item_id") % 20).alias("item_location_id"), F.col("n_chars").alias("item_rating_reviews_count"))
    words = F.when(n % 5 == 0, " near the old town").otherwise("")
    searched = [
        F.concat(kind, F.lit(" "), (F.floor(n / 3) % 311).cast("string"), words).alias("search_query"), (u % 23).alias("search_location_id"), F.when(n % 4 == 0, "colour red").alias("search_infm_params_text"),
        (u % 3).cast("int").alias("search_category"), F.when(n % 11 == 0, 1).otherwise(0).alias("search_is_delivery_search"),
    ]
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type").crossJoin(F.broadcast(total))  # total is one row
    item = F.pmod(F.xxhash64(n), F.col("total"))
    train = events.select(*searched, item.alias("item_id"), F.when(n % 3 == 0, u % 23).otherwise(item % 20).alias("item_location_id"), n.alias("train_row_id"))
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    c = F.col("c_custkey").cast("long")
    asked = table(spark, sf, "customer").select(c.alias("event_id"), (c * 7).alias("user_id"), F.get(kinds, (c % 5).cast("int")).alias("event_type"))
    bench = asked.select(F.concat(F.lit("ben"), F.lpad(n.cast("string"), 13, "0")).alias("query_id"), *searched)
    return train, corpus, bench


@query()
def split_build(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata of all sets of a whole split (no SQL: the greedy selection; the tests have a plain version)."""
    return build(*_from_tables(spark, sf)).meta
