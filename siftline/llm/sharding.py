"""Sharding: k-d tree partitioning by distributed weighted medians, in DataFrame functions only.

The dimensions are metadata: source, language and size. Each is a coordinate of 12 bits. A node of the tree is split
along its widest dimension at the place where its bytes halve (or divide as the shards of its two sides do). The
place is found by histograms of at most 4096 bins a node, aggregated where the rows are: one over the coordinate,
then, in the bin that holds the median, one over a hash of the text, and, where the copies of one text are too heavy
to stay together, one over a hash of the row. So sizes come out near equal whatever single value is frequent.
All nodes of a level are split at once; histograms and splits are tables, and the driver sees none of their rows.

Equal texts share their coordinates (the least source and language of the group), so they stay in one shard
unless the group is heavier than ``tolerance`` of a shard and lies across a median.

Defined results: a null text has no bytes (size 1); null source or language is a value of its own; repeated rows are
separate rows that may be parted; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

BITS = 12
BINS = 1 << BITS
SLOT_CELL_ROWS = 4096
NAMES = ("c_source", "c_lang", "c_size")
#: Levels of the tree after which the rows' nodes are written down.
STAGED_LEVELS = 4


def _coordinate(c: Column) -> Column:
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 64 - BITS), F.lit(0)).cast("int")


def _median_bins(hist: DataFrame, by: list[str], bin_: str, wanted: Column) -> DataFrame:
    """Per group of a histogram (w by ``bin_``) the bin in which ``wanted`` is reached: its w, and ``want``, the part of it.

    A group has 4096 bins at most."""
    order = Window.partitionBy(*by).orderBy(bin_)
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = hist.select("*", before.alias("before"), F.lead(bin_).over(order).isNull().alias("last"), wanted.alias("goal"))
    at = (F.col("before") < F.col("goal")) & ((F.col("before") + F.col("w") >= F.col("goal")) | F.col("last"))
    return summed.where(at).select(*[c for c in hist.columns if c != "wanted"], (F.col("goal") - F.col("before")).alias("want"))


def _splits(live: DataFrame, scale: list[float], tolerable: float) -> DataFrame:
    """Where each node is split: node, dim, bin, side, text_bin, text_side, row_bin.

    ``side`` is 1 or 0 where the bin of the median goes right or left as a whole, and -1 where it is heavier than
    ``tolerable`` and must be parted; ``text_side`` alike for the bin of hashes of texts in it.
    """
    side = F.when(F.col("w") <= tolerable, (F.col("want") < F.col("w") / 2).cast("int")).otherwise(F.lit(-1))
    long_ = live.select("node", "n", "w", F.posexplode(F.array(*NAMES)).alias("dim", "bin"))
    hist = long_.groupBy("node", "n", "dim", "bin").agg(F.sum("w").alias("w"))
    each = Window.partitionBy("node", "dim")
    width = (F.max("bin").over(each) - F.min("bin").over(each)) / F.get(F.array(*map(F.lit, scale)), F.col("dim"))
    hist = hist.select("*", F.struct(width, -F.col("dim")).alias("width"), F.sum("w").over(each).alias("total"))
    hist = hist.select("*", F.max("width").over(Window.partitionBy("node")).alias("widest")).where("width = widest").drop("width", "widest")
    share = F.floor(F.col("n") / 2) / F.col("n")
    cuts = _median_bins(hist, ["node", "dim"], "bin", F.col("total") * share)
    cuts = workspace.stage(cuts.select("node", "dim", "bin", side.alias("side"), "want"), "shard-cuts")
    cuts = workspace.lookup(cuts)
    # Inside the bins that hold a median and are too heavy: by a hash of the text, then by one of the row.
    heavy = cuts.where("side < 0").select("node", "dim", "bin", F.col("want").alias("wanted"))
    inside = live.join(heavy, "node").where(F.get(F.array(*NAMES), F.col("dim")) == F.col("bin"))
    texts = inside.groupBy("node", "wanted", "h_text").agg(F.sum("w").alias("w"))
    texts = _median_bins(texts, ["node"], "h_text", F.col("wanted"))
    texts = workspace.stage(texts.select("node", F.col("h_text").alias("text_bin"), side.alias("text_side"), F.col("want").alias("text_want")), "shard-texts")
    texts = workspace.lookup(texts)
    single = texts.where("text_side < 0").select("node", "text_bin", F.col("text_want").alias("wanted"))
    within = inside.drop("wanted").join(single, "node").where("h_text = text_bin")
    within = within.groupBy("node", "wanted", "h_row").agg(F.sum("w").alias("w"))
    ends = _median_bins(within, ["node"], "h_row", F.col("wanted"))
    ends = ends.select("node", (F.col("h_row") - (F.col("want") < F.col("w") / 2).cast("int")).alias("row_bin"))
    both = cuts.drop("want").join(texts.drop("text_want"), "node", "left").join(ends, "node", "left")
    return workspace.stage(both, "shard-splits")


def _parted(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Moves every row to a child of its node (2 * node, 2 * node + 1); rows of leaves stay.

    ``splits`` has one row a node, and is broadcast if these are counted to be few.
    """
    at = F.get(F.array(*NAMES), F.col("dim"))
    right = (
        F.when(at != F.col("bin"), (at > F.col("bin")).cast("int"))
        .when(F.col("side") >= 0, F.col("side"))
        .when(F.col("h_text") != F.col("text_bin"), (F.col("h_text") > F.col("text_bin")).cast("int"))
        .when(F.col("text_side") >= 0, F.col("text_side"))
        .otherwise((F.col("h_row") > F.col("row_bin")).cast("int"))
    )
    met = rows.join(workspace.lookup(splits), "node", "left").select("*", F.when(F.col("dim").isNotNull(), F.coalesce(right, F.lit(0))).alias("right"))
    left_n = F.floor(F.col("n") / 2).cast("int")
    return met.select(
        *[c for c in rows.columns if c not in ("node", "n", "first")],
        F.when(F.col("right").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.col("right")).alias("node"),
        F.when(F.col("right").isNull(), F.col("n")).when(F.col("right") == 1, F.col("n") - left_n).otherwise(left_n).alias("n"),
        F.when(F.col("right") == 1, F.col("first") + left_n).otherwise(F.col("first")).alias("first"),
    )


def kd_leaves(rows: DataFrame, n_shards: int, tolerance: float) -> DataFrame:
    """``rows`` (w, NAMES, h_text, h_row) with the shard of the leaf that each comes to: node, n (1), first (the shard).

    A node of n shards has children of floor(n / 2) and the rest, so how deep the tree is follows from n_shards.
    """
    extent = rows.agg(F.sum("w").alias("w"), *[(F.max(c) - F.min(c)).alias(c) for c in NAMES]).first()
    scale = [float(max(1, extent[c] or 0)) for c in NAMES]
    tolerable = tolerance * (extent.w or 0) / n_shards
    rows = rows.select("*", F.lit(1).cast("long").alias("node"), F.lit(n_shards).cast("int").alias("n"), F.lit(0).cast("int").alias("first"))
    for level in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        if level and level % STAGED_LEVELS == 0:
            rows = workspace.stage(rows, "shard-nodes")
        rows = _parted(rows, _splits(rows.where("n > 1"), scale, tolerable))
    return rows


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    tolerance: float = 0.01,
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: ``key``, size, text_crc32, shard, slot (gapless from 0 in its shard).

    Give the number of shards, or the bytes that a shard may have.
    """
    raw = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("w"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.col(source).alias("src"), F.col(lang).alias("lg"),
    )
    raw = workspace.stage(raw, "shard-rows")
    # The coordinates of copies; written first, so that the copies of one text can be split over tasks in the join.
    groups = raw.groupBy("h", "crc", "w").agg(F.min("src").alias("g_src"), F.min("lg").alias("g_lg"), F.count("*").alias("copies")).where("copies > 1")
    groups = workspace.stage(groups, "shard-groups")
    met = raw.join(groups, ["h", "crc", "w"], "left")
    of_group = lambda one, least: F.when(F.col("copies").isNull(), F.col(one)).otherwise(F.col(least))
    rows = met.select(
        "key", "w", "crc", _coordinate(of_group("src", "g_src")).alias("c_source"), _coordinate(of_group("lg", "g_lg")).alias("c_lang"),
        F.least(F.floor(F.log2(F.col("w").cast("double")) * 100), F.lit(BINS - 1)).cast("int").alias("c_size"),
        F.pmod(F.col("h"), F.lit(BINS)).cast("int").alias("h_text"),
        F.pmod(F.xxhash64("key", F.lit(7)), F.lit(BINS)).cast("int").alias("h_row"),
    )
    rows = workspace.stage(rows, "shard-points")
    workspace.drop(raw)
    if n_shards is None:
        n_shards = max(1, math.ceil((rows.agg(F.sum("w")).first()[0] or 0) / target_bytes))
    placed = kd_leaves(rows, n_shards, tolerance).select("key", "w", "crc", F.col("first").alias("shard"))
    cells = max(1, rows.count() // (n_shards * SLOT_CELL_ROWS))
    placed = workspace.stage(placed.withColumn("cell", F.pmod(F.xxhash64("crc", "key"), F.lit(cells)).cast("int")), "shard-placed")
    workspace.drop(rows)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.select("*", (F.row_number().over(Window.partitionBy("shard", "cell").orderBy("crc", "key")) - 1).alias("nr"))
    return numbered.join(before, ["shard", "cell"]).select(
        F.col("key").alias(key), F.col("w").alias("size"), F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("nr")).cast("long").alias("slot")
    )
