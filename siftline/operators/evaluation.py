"""Answers checked and measured: recall, curves, segments, raking weights, bootstrap intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import math as M

K = 50
ID_PATTERN = "^[0-9a-f]{16}$"


def answers(ranked: DataFrame, k: int = K) -> DataFrame:
    """query_id, answer: the first k ids, by rank, with single spaces."""
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("xs"))
    return top.select("query_id", F.array_join(F.transform("xs", lambda x: x["item_id"].cast("string")), " ").alias("answer"))


def answer_items(answer: DataFrame, k: int = K) -> DataFrame:
    """query_id, item_id (string): the distinct ones of the first k."""
    ids = F.array_distinct(F.slice(F.split("answer", " "), 1, k))
    return answer.where(F.coalesce("answer", F.lit("")) != "").select("query_id", F.explode(ids).alias("item_id"))


def recall(qrels: DataFrame, predicted: DataFrame) -> DataFrame:
    """query_id, n_rel, n_hit, recall for every query with relevant items; without an answer it is 0."""
    met = qrels.select("query_id", "item_id").join(predicted.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    out = met.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_hit"))
    return out.withColumn("recall", F.col("n_hit") / F.col("n_rel"))


def recall_curve(qrels: DataFrame, pool: DataFrame, ks: list[int]) -> DataFrame:
    """One row: the mean recall at each depth, and the mean size of the pool."""
    met = qrels.join(pool.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    by_query = met.groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"h{k}") for k in ks])
    curve = by_query.agg(*[F.round(F.avg(F.col(f"h{k}") / F.col("n")), 6).alias(f"recall_{k}") for k in ks])
    size = pool.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_pool_size"))
    return curve.crossJoin(size)  # each is one row


def segments(per_query: DataFrame, names: list[str]) -> DataFrame:
    """segment, value, recall, n for each of the columns ``names``."""
    parts = [per_query.groupBy(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n")) for s in names]
    return reduce(DataFrame.unionByName, parts)


def check_answer(answer: DataFrame, queries: DataFrame, items: DataFrame, k: int = K, strict: bool = True) -> DataFrame:
    """rule, n, severity of every rule that an answer table must keep; n is the number of rows (or queries) that break it."""
    if answer.columns != ["query_id", "answer"]:
        return answer.sparkSession.createDataFrame([("columns", 1, "error")], "rule string, n long, severity string")
    known = items.select(F.col("item_id").alias("id")).distinct()
    ids = F.when(F.coalesce("answer", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("answer", " "))
    rows = answer.select("query_id", ids.alias("ids")).withColumn("row", F.monotonically_increasing_id())
    bad_id = F.exists("ids", lambda x: ~x.rlike(ID_PATTERN))
    count = lambda cond, name: F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias(name)
    flat = rows.agg(
        count(F.length("query_id") != 16, "query_id_length"), count(bad_id, "bad_ids"), count(F.size("ids") > k, "too_many"),
        count(F.size("ids") != F.size(F.array_distinct("ids")), "duplicated_ids"), count(F.size("ids") < k, "too_few"), (F.count("*") - F.count_distinct("query_id")).alias("duplicated_queries"),
    )
    asked = answer.select("query_id").distinct()
    extra = asked.join(queries.select("query_id"), "query_id", "left_anti").agg(F.count("*").alias("unknown_queries"))
    missing = queries.select("query_id").distinct().join(asked, "query_id", "left_anti").agg(F.count("*").alias("missing_queries"))
    listed = rows.select("row", F.explode("ids").alias("id")).where(F.col("id").rlike(ID_PATTERN))
    unknown = listed.join(known, "id", "left_anti").agg(F.count_distinct("row").alias("unknown_ids"))
    one = flat.crossJoin(extra).crossJoin(missing).crossJoin(unknown)  # each is one row
    warn = {"too_few"} | (set() if strict else {"missing_queries"})
    rules = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n"), F.lit("warning" if c in warn else "error").alias("severity")) for c in one.columns])
    return one.select(F.explode(rules).alias("x")).select("x.rule", "x.n", "x.severity")


HOLD_WORDS = 5


def holders(items: DataFrame, passages: DataFrame, text: str = "text", passage: str = "text") -> DataFrame:
    """query_id, item_id of all items whose text holds a passage, as it is, anywhere.

    A passage's second to sixth words stand whole and side by side in any text that holds it, so these are looked up
    among the runs of words of all texts by a hash, and what meets is verified. Passages of fewer than seven words are
    compared with all texts: a stated set of queries.
    """
    words = lambda c: F.split(c, "[ \t\n\x0b\f\r]+")
    q = passages.select("query_id", F.col(passage).alias("passage")).where("passage is not null").withColumn("w", words(F.col("passage")))
    run = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(HOLD_WORDS)])
    long_ = q.where(F.size("w") >= HOLD_WORDS + 2).select("query_id", "passage", run(F.col("w"), F.lit(1)).alias("h"))
    t = items.select("item_id", F.col(text).alias("text"), words(F.col(text)).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - HOLD_WORDS), lambda i: run(F.col("w"), i))
    met = t.where(F.size("w") >= HOLD_WORDS).select("item_id", F.explode(runs).alias("h")).join(long_.select("h").distinct(), "h").distinct()
    pairs = met.join(long_, "h").join(t.select("item_id", "text"), "item_id").where(F.contains("text", "passage"))
    short = q.where(F.size("w") < HOLD_WORDS + 2).select("query_id", "passage")
    few = t.select("item_id", "text").join(F.broadcast(short.limit(SHORT_PASSAGES)), F.contains("text", "passage"))
    if short.limit(SHORT_PASSAGES + 1).count() > SHORT_PASSAGES:
        raise ValueError(f"more than {SHORT_PASSAGES} passages have fewer than {HOLD_WORDS + 2} words")
    return pairs.select("query_id", "item_id").unionByName(few.select("query_id", "item_id"))


#: Short passages that are compared with all texts.
SHORT_PASSAGES = 10_000
RAKE_CELLS = 1_000_000


def rake(cells: DataFrame, target: DataFrame, columns: list[str], passes: int = 50) -> DataFrame:
    """Weights of mean 1 that bring the marginals of ``columns`` to those of ``target``, by iterative proportional fitting.

    Rows of equal values have equal weights, so the fit runs on cells (the distinct combinations of segment labels, with
    count n), a table whose size hangs on the labels, not on the rows; that size is checked. Values are visited in
    sorted order, as each rescaling changes the total. Values that either side lacks are left alone.
    """
    listed = cells.limit(RAKE_CELLS + 1).collect()
    if len(listed) > RAKE_CELLS:
        raise ValueError(f"more than {RAKE_CELLS} cells: {', '.join(columns)} aren't segment labels")
    shares = []
    for c in columns:
        counts = target.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).limit(RAKE_CELLS + 1).collect()
        if len(counts) > RAKE_CELLS:
            raise ValueError(f"more than {RAKE_CELLS} values of {c} in the target: these aren't segment labels")
        total = sum(r.n for r in counts)
        shares.append({r.v: r.n / total for r in counts if r.v is not None})
    weights = rake_on_driver([(r.n, *(None if r[c] is None else str(r[c]) for c in columns)) for r in listed], shares, passes)
    rows = [(*(None if r[c] is None else str(r[c]) for c in columns), r.n, w) for r, w in zip(listed, weights)]
    return cells.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns) + ", n long, w double")


def rake_on_driver(cells: list[tuple], shares: list[dict[str, float]], passes: int = 50) -> list[float]:
    """The fit over rows (n, value, value, ...)."""
    w = [1.0] * len(cells)
    for _ in range(passes):
        for j, share in enumerate(shares, 1):
            for v in sorted({c[j] for c in cells if c[j] is not None}):
                rows = [i for i, c in enumerate(cells) if c[j] == v]
                s, total = sum(w[i] * cells[i][0] for i in rows), sum(x * c[0] for x, c in zip(w, cells))
                if s > 0 and share.get(v, 0) > 0:
                    for i in rows:
                        w[i] *= share[v] * total / s
    mean = sum(x * c[0] for x, c in zip(w, cells)) / max(1, sum(c[0] for c in cells))
    return [x / mean for x in w]


def bootstrap(values: DataFrame, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """One row: mean, and the 2.5 % and 97.5 % quantiles of the resampled means.

    ``values`` has idx (0 .. n-1). The draw r, i takes the value whose idx is mix(i, r) mod n; the stream differs from
    that of other generators, the statistics are the same.
    """
    n = values.agg(F.count("*").alias("total"))
    draws = values.select("idx").crossJoin(F.broadcast(n)).select(F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"), "idx", "total")
    draws = draws.select("rep", F.pmod(M.mix(F.col("idx") * 7919 + F.col("rep") * 104729, F.col("rep"), seed), F.col("total")).alias("idx"))
    means = draws.join(values.select("idx", F.col(value).alias("x")), "idx").groupBy("rep").agg(F.avg("x").alias("m"))
    out = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"))
    return values.agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n")).crossJoin(out)  # each is one row


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every experiment."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
