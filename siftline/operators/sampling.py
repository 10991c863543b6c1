"""Stratified allocation and selection, negative sampling, sample weights, splits without leaks."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.functions import text as T


def allocate(cells: DataFrame, n: int, cell: str = "cell", size: str = "size") -> DataFrame:
    """``cell``, ``size``, k: n places shared in proportion to size, the rest by largest remainders (then by cell)."""
    whole = Window.partitionBy()
    exact = F.lit(n) * F.col(size) / F.sum(size).over(whole)
    rows = cells.select(cell, size, F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("rest"))
    rows = rows.withColumn("left", F.lit(n) - F.sum("base").over(whole)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), cell)))
    return rows.select(cell, size, (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("k"))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``position``: a seeded permutation, by mix(key) and then key."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(M.mix(F.col(key), 0, seed), key)))


def first_per(rows: DataFrame, by: str, order: list) -> DataFrame:
    """The first row for each value of ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def searches(train: DataFrame, keys: list[str], corpus: DataFrame) -> DataFrame:
    """One row per search (the combination of ``keys``): n_rows, and rel, its chosen items that the corpus has."""
    known = train.join(corpus.select("item_id", F.lit(True).alias("_in")), "item_id", "left")
    return known.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(F.when(F.col("_in"), F.col("item_id")))).alias("rel"))


def location_table(train: DataFrame, corpus: DataFrame, named: dict[str, str], large: int = 2000, medium: int = 400, self_least: float = 0.3) -> DataFrame:
    """location, n_items, self_rate, loc_type. ``train`` has search_location_id, item_location_id; ``corpus`` item_location_id.

    A location that nobody searched from counts as one whose searches all stay there."""
    own = train.groupBy(F.col("search_location_id").alias("location")).agg(F.avg((F.col("search_location_id") == F.col("item_location_id")).cast("double")).alias("self_rate"))
    have = corpus.groupBy(F.col("item_location_id").alias("location")).agg(F.count("*").alias("n_items"))
    rows = own.join(have, "location", "full").select("location", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("self_rate", F.lit(1.0)).alias("self_rate"))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("location").cast("string")) if named else F.lit(None).cast("string")
    size = F.when(F.col("n_items") >= large, "city_L").when(F.col("n_items") >= medium, "city_M").otherwise("city_S")
    return rows.withColumn("loc_type", F.coalesce(name, F.when((F.col("self_rate") < self_least) | (F.col("n_items") == 0), "wide_other").otherwise(size)))


def history_features(queries: DataFrame, history: DataFrame) -> DataFrame:
    """Adds text_rows_in_history, seen_text, seen_same_loc, f_bucket; both sides have norm_q and search_location_id."""
    texts = history.groupBy("norm_q").agg(F.count("*").alias("text_rows_in_history"))
    places = history.select("norm_q", "search_location_id", F.lit(True).alias("seen_same_loc")).distinct()
    out = queries.join(texts, "norm_q", "left").join(places, ["norm_q", "search_location_id"], "left")
    out = out.fillna(0, ["text_rows_in_history"]).withColumn("seen_same_loc", F.coalesce("seen_same_loc", F.lit(False)))
    return out.withColumns({"seen_text": F.col("text_rows_in_history") > 0, "f_bucket": T.frequency_bucket(F.col("text_rows_in_history"))})


def without_leaks(train: DataFrame, taken: DataFrame, taken_items: DataFrame, taken_texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of neither a chosen search, nor a chosen item (rows without an item go too), nor a chosen text."""
    out = train.join(taken.select(*keys).distinct(), keys, "left_anti").where(F.col("item_id").isNotNull())
    return out.join(taken_items.select("item_id").distinct(), "item_id", "left_anti").join(taken_texts.select("norm_q").distinct(), "norm_q", "left_anti")


def likely(candidates: DataFrame, strata: list[str], limit: int, seen: str, convert: str = "0", frequency: str | None = None, rarest: int = 30) -> DataFrame:
    """Of every full cell the first ``limit`` candidates by position, and the ``limit`` rarest that can be converted to it."""
    converted = [F.lit(convert) if c == (frequency or strata[0]) else F.col(c) for c in strata]
    natural = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("position"))).where(F.col("_r") <= limit)
    extra = candidates.where(F.col(seen).between(1, rarest)).withColumn("_r", F.row_number().over(Window.partitionBy(*converted).orderBy(seen, "position"))).where(F.col("_r") <= limit)
    return natural.drop("_r").unionByName(extra.drop("_r")).dropDuplicates(["id"])


def select_stratified(
    candidates: DataFrame, strata: list[str], wanted: dict[str, list[tuple[tuple, int]]], seen: str | None = None, convert: str = "0", frequency: str | None = None, limit: int | None = None
) -> DataFrame:
    """Greedy selection for several splits that share no item: id, split, converted.

    ``candidates``: id, position, rel (its items), the columns ``strata`` (and ``seen``, rows of its text elsewhere);
    ``wanted``: for each split, how many of each full cell. Cells are filled exactly first; what is missing is filled
    with cells that agree on fewer strata from the left. Splits take turns in a cell. Texts with 1 to 30 other rows
    also stand in the cell whose ``frequency`` (the first stratum unless named) is ``convert``, after all that are there by
    nature, the rarest first. Each choice depends on the items taken before, so this runs in one task; callers bound its
    input. ``limit`` says that ``candidates`` are those of ``likely`` with this limit: if a choice hung on what that left
    out, a row with a null split says so, and the caller takes a larger limit.
    """
    names, place_of = list(wanted), strata.index(frequency) if frequency else 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        rows = list(pdf.itertuples(index=False))
        rarest = sorted(rows, key=lambda r: (getattr(r, seen), r.position)) if seen else rows
        need = {s: {tuple(map(str, c)): n for c, n in wanted[s]} for s in names}
        taken, items, out, short = set(), set(), [], False
        for depth in range(len(strata), -1, -1):
            pools, natural = defaultdict(list), defaultdict(int)
            for extra in (False, True):
                for r in rarest if extra else rows:
                    cell = [str(getattr(r, c)) for c in strata]
                    if extra:
                        if seen is None or not 1 <= getattr(r, seen) <= 30:
                            continue
                        cell[place_of] = convert
                    pools[tuple(cell[:depth])].append((r, extra))
                    natural[tuple(cell[:depth])] += not extra
            places = sorted({c[:depth] for s in names for c, n in need[s].items() if n > 0}, key=str)
            for place in places:
                queue, turn = pools.get(place, ()), 0
                sure = float("inf") if limit is None else limit if natural[place] >= limit else natural[place] + limit
                open_ = lambda s, place=place: next((c for c, n in sorted(need[s].items()) if n > 0 and c[: len(place)] == place), None)
                for number, (r, extra) in enumerate(queue):
                    order = [s for k in range(len(names)) if open_(s := names[(turn + k) % len(names)])]
                    if not order:
                        break
                    short |= number >= sure
                    rel = list(r.rel)
                    if r.id in taken or items.intersection(rel):
                        continue
                    split = order[0]
                    need[split][open_(split)] -= 1
                    taken.add(r.id)
                    items.update(rel)
                    out.append((r.id, split, extra))
                    turn = names.index(split) + 1
                short |= len(queue) >= sure and any(map(open_, names))
        if short:
            out.append((None, None, False))
        return pd.DataFrame(out, columns=["id", "split", "converted"])

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.groupBy().applyInPandas(run, f"id {kind}, split string, converted boolean")


def split_ids(rows: DataFrame, order: list, split: str = "split") -> DataFrame:
    """Adds query_id: the split's name and a number of 13 digits, from 0 in each split."""
    number = F.row_number().over(Window.partitionBy(split).orderBy(*order)) - 1
    return rows.withColumn("query_id", F.concat(F.col(split), F.lpad(number.cast("string"), 13, "0")))


def negatives(pairs: DataFrame, top: int = 300, one_in: int = 7, seed: int = 0) -> DataFrame:
    """Positives, everything ranked in the first ``top``, and one in ``one_in`` of the rest, by a hash of the pair."""
    chosen = F.pmod(M.mix(F.col("query_id") * 31 + F.col("item_id"), 0, seed), F.lit(one_in)) == 0
    return pairs.where((F.col("label") == 1) | (F.col("rank") <= top) | chosen)


def sample_weights(pairs: DataFrame, qrels: DataFrame, scale: float = 60.0) -> DataFrame:
    """Adds weight: scale / (all relevant items of the query) for positives, 1 for negatives."""
    counts = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return pairs.join(counts, "query_id", "left").withColumn("weight", F.when(F.col("label") == 1, F.lit(scale) / F.col("n_rel")).otherwise(1.0))
