"""MinHash near-duplicates: inverted join on signature coordinates.

A document is posted under each of its signature's (coordinate, value) pairs. Two documents are candidates if they
collide in at least ``matches`` coordinates; that number is set so that a pair at the threshold is missed with a
probability below one in a million. Counting is spared in two ways:

* skip: a document with fewer than ``matches`` values that anyone else has can't be in a pair at all;
* prefix: in a common order of values, rarest first, two documents that share ``matches`` of k values share one of
  their first k - matches + 1. Only these are posted for the join.

Texts with equal shingle sets are one document from the start. What is wanted are groups, so a posting list isn't
expanded into all its pairs: its most typical document (the one with most shared values) is compared with all others;
once those that are linked are one group, only pairs of different groups are left, fewer with each round. The last
round takes all that remain, unless the sets' sizes, the number of shingles that nobody else has, or the parities of
their shingles' hashes (which bound the difference from below) rule them out. Every candidate is confirmed on the
full shingle sets.

Defined results: null and empty texts, and those without words, have no shingles, are linked with nothing, and form
their own group; repeated rows and copies are in one group; different texts of one id are different documents, each
in its own group; a group of which some rows have no id is named by the least id of the others, one without any id by
null, and all of its rows count as kept. An empty table gives an empty result. Ids may be of any type that has an
order. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops, workspace
from .components import connected_components

COORDINATES = 48
MISS = 1e-6
HUB_ROUNDS = 2
PARITY_WORDS = 16
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**64 - 1, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest number of collisions that a pair of this similarity reaches but for a chance of ``miss``."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return t
    return k


def minhash(shingles: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k values for each set that isn't empty; a value tells its coordinate, so one number is one posting list."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), k), np.int64)
    if len(starts):
        for j in range(k):
            least = np.minimum.reduceat((shingles ^ _XOR[j]) * _ODD[j], starts)
            out[:, j] = textops.mix64(least + _XOR[j]).view(np.int64)
    return out


def _signatures(docs: DataFrame, ngram: int, k: int) -> DataFrame:
    """key, h, n, lo and hi (two hashes of the whole set), sig (null for an empty set), from key, h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in textops.utf8_batches(batch.column(2)):
                rows = len(bounds) - 1
                h, first = textops.shingle_sets(data, bounds, ngram)
                n = np.diff(first)
                some = n > 0
                lo, hi = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                if some.any():
                    lo[some] = np.add.reduceat(textops.mix64(h + np.uint64(1)), first[:-1][some])
                    hi[some] = np.add.reduceat(textops.mix64(h ^ _XOR[255]), first[:-1][some])
                sig = minhash(h, first, k)
                ends = np.concatenate([[0], np.cumsum(np.where(some, k, 0))]).astype(np.int32)
                own = [batch.column(c).slice(at, rows) for c in (0, 1)]
                sets = [pa.array(n, pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))]
                yield pa.RecordBatch.from_arrays(own + sets, names=["key", "h", "n", "lo", "hi", "sig"])

    return docs.select("key", "h", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, h long, n long, lo long, hi long, sig array<long>")


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    """rep, sig, shingles (the full sets, as hashes of 64 bits) and parity (for each of 1024 bits, whether the number of
    shingles that fall on it is odd; two sets differ in at least as many shingles as their parities do in bits), from
    rep, sig, text."""
    bits = 64 * PARITY_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in textops.utf8_batches(batch.column(2)):
                h, first = textops.shingle_sets(data, bounds, ngram)
                rows = len(bounds) - 1
                cell = np.repeat(np.arange(rows), np.diff(first)) * bits + (h % np.uint64(bits)).astype(np.int64)
                odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8)
                parity = pa.array(np.packbits(odd).view(np.int64))
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                parities = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * PARITY_WORDS), parity)
                own = [batch.column(c).slice(at, rows) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, sets, parities], names=["rep", "sig", "shingles", "parity"])

    return docs.select("rep", "sig", "text").mapInArrow(run, "rep long, sig array<long>, shingles array<long>, parity array<long>")


class _Threshold:
    """intersection / union >= similarity, in whole numbers."""

    def __init__(self, similarity: float):
        exact = Fraction(similarity).limit_denominator(1000)
        self.up, self.down = exact.numerator, exact.denominator

    def linked(self, both, n_a, n_b):
        return self.down * both >= self.up * (n_a + n_b - both)

    def possible(self, n_a, own_a, n_b, own_b):
        """Whether two sets can be linked, when of their shingles own_a and own_b are in no other set."""
        both = F.least(n_a - own_a, n_b - own_b)
        return self.linked(both, n_a, n_b)

    def near(self, parity_a, parity_b, n_a, n_b):
        """Whether two sets can be linked, by what their parities show of their difference."""
        differ = sum((F.bit_count(F.get(parity_a, k).bitwiseXOR(F.get(parity_b, k))) for k in range(1, PARITY_WORDS)), F.bit_count(F.get(parity_a, 0).bitwiseXOR(F.get(parity_b, 0))))
        return (self.down + self.up) * differ <= (self.down - self.up) * (n_a + n_b)


def _confirmed(pairs: DataFrame, sets: DataFrame, k_matches: int, limit: _Threshold) -> DataFrame:
    """The pairs (a, b) that collide often enough and are similar on their full sets."""
    left = sets.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("shingles").alias("set_b"))
    right = sets.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("shingles").alias("set_a"))
    met = pairs.join(left, "b").join(right, "a")
    collisions = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(collisions >= k_matches).where(limit.linked(both, F.size("set_a"), F.size("set_b"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, ngram: int = 5, similarity: float = 0.8, k: int = COORDINATES, hub_rounds: int = HUB_ROUNDS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id (the least id of its group), kept."""
    limit, matches = _Threshold(similarity), least_matches(k, similarity)
    # Ids in an order that has those that are missing last; h tells the texts of one id apart.
    own = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"))
    named = docs.select(own.alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    signed = workspace.stage(_signatures(named, ngram, k), "near-signed")
    # A node is a set of shingles, whatever rows have it; its number is fixed by writing it down.
    nodes = signed.where("n > 0").groupBy("lo", "hi", "n").agg(F.min(F.struct("key", "h")).alias("row"), F.first("sig").alias("sig"))
    reps = workspace.stage(nodes.select("lo", "hi", "n", "row.key", "row.h", "sig", F.monotonically_increasing_id().alias("rep")), "near-reps")
    candidates, posts = _candidates(reps, k, matches)
    # One text of each node is needed; copies of a row are combined where they are before anything is shuffled.
    texts = named.groupBy("key", "h").agg(F.first("text").alias("text")).join(candidates.select("key", "h", "rep", "sig"), ["key", "h"])
    sets = workspace.stage(_sets(texts, ngram), "near-sets")
    labels = _linked(posts, sets, matches, limit, hub_rounds).withColumnRenamed("id", "rep")
    # What is joined with rows that may be many for one key is written first: such joins can be split.
    linked = reps.select("rep", "key").join(labels, "rep")
    least = workspace.stage(linked.groupBy("component").agg(F.min("key").alias("least")), "near-least")
    named_labels = labels.join(least, "component").select("rep", "least")
    groups = reps.select("lo", "hi", "n", "rep", "key").join(named_labels, "rep", "left").select("lo", "hi", "n", F.coalesce("least", "key").alias("least"))
    groups = workspace.stage(groups, "near-groups")
    out = signed.select("key", "n", "lo", "hi").join(groups, ["lo", "hi", "n"], "left").withColumn("least", F.coalesce("least", "key"))
    return out.select(F.col("key.id").alias(key), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("key") == F.col("least")).alias("kept"))


def _candidates(reps: DataFrame, k: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that may be in a pair (rep, sig, key, h), and their prefix posts (token, rep, n, shared)."""
    all_posts = reps.select("rep", "n", F.explode("sig").alias("token"))
    common = all_posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = all_posts.join(common, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("values"))  # k values at most
    shared = shared.where(F.size("values") >= matches)
    prefix = shared.select("rep", "n", F.size("values").alias("shared"), F.explode(F.slice("values", 1, F.size("values") - (matches - 1))).alias("v"))
    prefix = workspace.stage(prefix.select(F.col("v.token").alias("token"), "rep", "n", "shared"), "near-prefix")
    lists = workspace.stage(prefix.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "near-lists")
    posts = workspace.stage(prefix.join(lists, "token", "left_semi"), "near-posts")
    workspace.drop(prefix, lists)
    met = posts.select("rep").distinct()
    return workspace.stage(reps.join(met, "rep", "left_semi").select("rep", "sig", "key", "h"), "near-candidates"), posts


def _linked(posts: DataFrame, sets: DataFrame, matches: int, limit: _Threshold, hub_rounds: int) -> DataFrame:
    """id and component of all documents that are linked with another."""
    # A posting list may be as long as a group of near copies: joins by token read written tables on both sides, so that
    # a long list is split over tasks.
    left = posts.withColumn("component", F.col("rep"))
    edges = None
    labels = None
    for turn in range(hub_rounds + 1):
        # Only lists in which groups still differ are of interest.
        mixed = left.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.struct("shared", (-F.col("rep")).alias("negated"))).alias("hub"), F.min("n").alias("n_min"))
        mixed = workspace.stage(mixed.where("c0 <> c1").select("token", "n_min", (-F.col("hub.negated")).alias("hub")), "near-mixed")
        left = workspace.stage(left.join(mixed, "token"), f"near-left{turn}")
        if left.isEmpty():
            break
        if turn < hub_rounds:
            hubs = left.where("rep = hub").select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
            hubs = workspace.stage(hubs.distinct(), "near-hubs")
            met = left.join(hubs, "token").where("component <> c_a").where(limit.linked(F.least("n", "n_a"), F.col("n"), F.col("n_a")))
            pairs = met.select("a", F.col("rep").alias("b")).distinct()
        else:
            pairs = _remaining(left, sets, limit)
        found = workspace.stage(_confirmed(pairs, sets, matches, limit), "near-edges")
        edges = found if edges is None else edges.unionByName(found)
        labels = workspace.stage(connected_components(edges), "near-labels")
        if turn < hub_rounds:
            rest = left.where("rep <> hub").select("token", "rep", "n", "shared")
            left = workspace.stage(rest.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "near-rest")
    return labels if labels is not None else posts.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)


def _remaining(left: DataFrame, sets: DataFrame, limit: _Threshold) -> DataFrame:
    """All pairs of different groups in the posting lists that sizes and single shingles don't rule out."""
    shingles = sets.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("shingles").alias("s")).distinct()
    single = shingles.groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1")
    own = single.groupBy("rep").agg(F.count("*").alias("own"))
    rows = left.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # The best partner that a document could have holds all that isn't its own, and nothing else.
    shared = F.col("n") - F.col("own")
    rows = rows.where(limit.linked(shared, F.col("n"), F.greatest(F.col("n_min"), shared)))
    rows = rows.select("token", "rep", "n", "own", "component").join(sets.select("rep", "parity"), "rep")
    rows = workspace.stage(rows, "near-open")
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("m"))
    main = workspace.stage(sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("most")).select("token", F.col("most.component").alias("main")), "near-main")
    rows = workspace.stage(rows.join(main, "token"), "near-open")
    few = rows.where("component <> main").select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"), F.col("component").alias("c_a"), F.col("parity").alias("parity_a"))
    met = rows.join(few, "token").where("component <> c_a and (component = main or rep < a)")
    met = met.where(limit.possible(F.col("n"), F.col("own"), F.col("n_a"), F.col("own_a")))
    met = met.where(limit.near("parity", "parity_a", F.col("n"), F.col("n_a")))
    return met.select(F.greatest("a", "rep").alias("a"), F.least("a", "rep").alias("b")).distinct()
