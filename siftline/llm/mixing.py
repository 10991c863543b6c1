"""Mixing sources to target weights: pivotal dependent rounding with a distributed reduction tree.

A source's target is its weight's part of the wanted total, but at most ``max_repeat`` times its size; what is beyond
is shared again by weight among the others. Each document of a source gets the same expected number of copies
r = target / source size: floor(r) certain copies and a fractional one. The fractions are rounded in pairs: words move
between the two at random, keeping both expectations and their sum, until one is whole. A cell (a bounded part of
a source, so that no source is one task) thereby leaves one document with a fraction; those of 64 cells meet in the
next level of the tree, and the last one of a source is rounded alone. So the words taken from a source differ from
its target by less than its largest document.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source, the last; repeated rows are
rounded each on its own; an empty table gives an empty result; sources without words have the target 0. All random
numbers are hashes of the row and the level, so reruns agree. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops, workspace

SEED = 20240611
FAN_IN = 64
NO_SOURCE = "\u0000null"


def _ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with rank: 0, 1, 2 ... by code point of src, null last. Sorted over many tasks, however many sources."""
    last = (F.col("src") == NO_SOURCE).cast("int")
    dealt = totals.repartitionByRange(last, "src").sortWithinPartitions(last, "src")
    dealt = workspace.stage(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "mix-ranked")
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))  # one row a task
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(counts.select("part", before.alias("before")), "part").select(*totals.columns, (F.col("before") + F.col("at")).alias("rank"))


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """src, n, source_size, target: sources by code point, null last, with ``weights`` repeating; water filling.

    Sources fill at speeds in proportion to their weights. The level rises to where the sources that aren't full would
    hold what the full ones leave; those that are full at that level then keep their caps, and it rises again, until
    no other source is full. Each round is one aggregate of three numbers.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(totals).select("src", "n", "source_size", F.get(cycle, F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")).alias("w"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"))
    ranked = workspace.stage(ranked, "mix-weights")
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") <= F.col("w") * F.lit(level)
        got = ranked.agg(F.count_if(is_full).alias("full"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(is_full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if got.full == full or not got.open:
            break
        level, full = max(level, (wanted - got.held) / got.open), got.full
    target = F.when(is_full, F.col("cap")).otherwise(F.col("w") * F.lit(level))
    return ranked.select("src", "n", "source_size", F.least("cap", target).alias("target"))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rounds the fractions of one cell; the one that is left, if any, keeps its fraction."""
    pdf = pdf.sort_values(["u", "key", "size", "nr"], kind="stable", na_position="last").reset_index(drop=True)
    x, size, u = pdf["x"].to_list(), pdf["size"].to_list(), pdf["u"].to_list()
    open_ = -1
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up, down = min(size[j] * (1 - x[j]), size[i] * x[i]), min(size[j] * x[j], size[i] * (1 - x[i]))
        if u[i] * (up + down) < down:  # words move from i to j
            full, none = size[j] * (1 - x[j]) <= size[i] * x[i], size[i] * x[i] <= size[j] * (1 - x[j])
            x[j], x[i] = (1.0 if full else x[j] + up / size[j]), (0.0 if none else x[i] - up / size[i])
        else:
            none, full = size[j] * x[j] <= size[i] * (1 - x[i]), size[i] * (1 - x[i]) <= size[j] * x[j]
            x[j], x[i] = (0.0 if none else x[j] - down / size[j]), (1.0 if full else x[i] + down / size[i])
        open_ = next((k for k in (j, i) if 0.0 < x[k] < 1.0), -1)
    pdf["x"] = x
    return pdf


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeat: float = 2.0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    cell_rows: int = 2000,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, src, size (words), source_size, target, copies."""
    # Rows that are alike in id, source and size are counted, then numbered: so many rows of one id, or of none, come
    # into many cells, and random numbers depend on the rows alone.
    measured = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("src"), textops.count_words(textops.text_or_empty(text)).alias("size"))
    alike = workspace.stage(measured.groupBy("key", "src", "size").agg(F.count("*").alias("times")), "mix-sizes")
    totals = alike.groupBy("src").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("size")).alias("source_size"))
    targets = workspace.stage(source_targets(totals, weights, share, max_repeat), "mix-targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    cells = F.greatest(F.ceil(F.col("n") / cell_rows), F.lit(1))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = workspace.numbered(alike, "times", "nr").join(targets, "src").select(
        "key", "src", "size", "nr", "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("fraction"),
        F.pmod(F.xxhash64("key", "size", "nr", F.lit(SEED)), cells).alias("cell"),
    )
    rows = rows.select("key", "src", "size", "nr", "source_size", "target", "whole", F.when(F.col("size") > 0, F.col("fraction")).otherwise(F.lit(0.0)).alias("x"), "cell")
    done, level = [], 0
    left = max(1, math.ceil(most / cell_rows))
    while True:
        chance = (F.shiftrightunsigned(F.xxhash64("key", "size", "nr", F.lit(level), F.lit(SEED)), 11).cast("double") * F.lit(2.0**-53)).alias("u")
        rows = rows.select("key", "src", "size", "nr", "source_size", "target", "whole", "x", "cell", chance)
        rows = workspace.stage(rows.groupBy("src", "cell").applyInPandas(_settle, rows.schema), f"mix-level{level}")
        open_ = (F.col("x") > 0) & (F.col("x") < 1)
        done.append(rows.where(~open_))
        rows = rows.where(open_).withColumn("cell", F.floor(F.col("cell") / FAN_IN))
        if left == 1:
            break
        left, level = math.ceil(left / FAN_IN), level + 1
    last = F.shiftrightunsigned(F.xxhash64("key", "size", "nr", F.lit(SEED + 1)), 11).cast("double") * F.lit(2.0**-53)
    done.append(rows.withColumn("x", F.when(last < F.col("x"), 1.0).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), "src", "size", "source_size", "target", (F.col("whole") + F.col("x")).cast("long").alias("copies"))
