"""Quality rules: robust multivariate outliers (minimum covariance determinant), in DataFrame functions only.

Each document is described by statistics of its whole text, transformed to a vector of four numbers. For each language
and source the vectors' centre and scatter are those of the ``coverage`` share of its rows with the least determinant
of the scatter. As groups come in every size, the scatter is regularised (the minimum regularized covariance
determinant): it is drawn to the scatter that all groups have in common around their medians, with a weight that falls
with the group's size, prior_rows / (rows + prior_rows). There is no least size: a group of one row has that row
as its centre. The least determinant is sought as is usual: several starts (the quartiles, the common scatter, and
small random subsets), two concentration steps from each (keep the rows with the least Mahalanobis distances, take
their mean and scatter), then the start with the least determinant goes on until it no longer falls. Documents
farther out than ``cutoff`` are rejected.

Defined results: a null text counts as empty; null language or source form a group of their own; repeated rows are
judged each on its own and alike; where starts tie in their determinants, the first one holds. An empty table gives an
empty result. Columns of the input other than those asked for are ignored, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops, workspace

SYMBOLS = "#*$%&|<>"
WINDOW = 8
DIMS = ("x0", "x1", "x2", "x3")
#: Standard deviations below which a spread isn't believed, by dimension.
FLOORS = (0.05, 0.4, 0.5, 0.5)
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
MEANS, SCATTERS = [f"m{i}" for i in range(4)], [f"s{i}{j}" for i, j in PAIRS]
#: Random subsets that are starts, how many rows each has on average, and concentration steps at most for the best one.
SUBSETS, SUBSET_ROWS, MAX_STEPS = 3, 8, 12
#: Determinants that differ by less count as equal (they are compared as logarithms).
LEAST_FALL = 1e-6


def base_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    t = textops.text_or_empty(text)
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    windows = F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(textops.SPACES)) != "")
    # Windows found twice or more, by sorting (hash, position); covered words, by the gaps between their positions.
    ranked = F.array_sort(F.transform("_win", lambda w, i: F.struct(w.alias("h"), i.alias("i"))))
    twice = F.filter("_ranked", lambda x, k: F.coalesce(F.get("_ranked", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_ranked", k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    out = docs.select(*keep, t.alias("_text"), textops.word_array(t).alias("_words"), lines.alias("_lines"))
    out = out.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", textops.SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_h"),
    )
    names = [c for c in out.columns if c != "_h"]
    out = out.select(*names, windows.alias("_win"))
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    out = out.select(*names, F.when(repeated, ranked).otherwise(F.lit(None)).alias("_ranked"))
    out = out.select(*names, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_at"))
    return out.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: mean word length (drawn to 5 in short texts), and the shares of symbols among
    characters and of repeated lines and repeated words among words, on a log scale."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.ln((F.col("word_chars") + 500.0) / (F.col("n_words") + 100.0)),
        F.ln(F.col("n_symbols") / chars + 0.01),
        F.ln(F.col("n_dup_lines") / words + 0.01),
        F.ln(F.col("n_repeat_words") / words + 0.1),
    ]


def _consistency(coverage: float) -> float:
    """The factor that makes the covariance of the inner ``coverage`` share of a normal sample in 4 dimensions unbiased."""
    chi4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi4(mid) < coverage else (low, mid)
    half = low / 2
    return coverage / (1 - math.exp(-half) * (1 + half + half * half / 2))


def _with_root(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the 4 x 4 scatter s_ij, and log_det, its determinant's logarithm.

    The spread floors keep it positive definite."""
    # One select: each value may name those before it.
    values = []
    for i, j in PAIRS:
        floor = FLOORS[i] ** 2
        rest = " - ".join([f"(s{i}{j}{f' + {floor}D' if i == j else ''})"] + [f"l{i}{k} * l{j}{k}" for k in range(j)])
        values.append(f"sqrt(greatest({rest}, {floor / 4}D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    log_det = " + ".join(f"2 * ln(l{i}{i})" for i in range(4))
    return estimates.selectExpr(*[c for c in estimates.columns if c not in SCATTERS], *values, f"{log_det} AS log_det")


def _distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i in range(4):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _concentrated(rows: DataFrame, estimates: DataFrame, by: list[str], coverage: float, target: list[float], prior_rows: float, few: bool) -> DataFrame:
    """One concentration step: ``by``, the new centre m, root l and log_det.

    ``rows`` has g, n and the vector; ``target`` the scatter that small groups are drawn to; ``few`` says that the
    groups were counted to be few, so that a row for each goes to all tasks."""
    far = rows.join(F.broadcast(estimates.drop("log_det")) if few else estimates.drop("log_det"), "g").select(*by, "n", *DIMS, _distance().alias("d2"))
    cut = far.groupBy(*by).agg(F.percentile_approx("d2", coverage, 2000).alias("cut"))
    inner = far.join(F.broadcast(cut) if few else workspace.stage(cut, "outlier-cut"), by).where(F.col("d2") <= F.col("cut"))
    moments = inner.groupBy(*by).agg(F.max("n").alias("n"), *_moments())
    return workspace.stage(_with_root(_regularised(moments, _consistency(coverage), target, prior_rows)), "outlier-step")


def _moments() -> list[Column]:
    return [F.avg(x).alias(m) for x, m in zip(DIMS, MEANS)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i, j in PAIRS]


def _regularised(moments: DataFrame, factor: float, target: list[float], prior_rows: float) -> DataFrame:
    """Scatters drawn to ``target``; ``n`` goes."""
    drawn = F.lit(float(prior_rows)) / (F.col("n") + F.lit(float(prior_rows)))
    others = [c for c in moments.columns if c not in SCATTERS and c != "n"]
    return moments.select(*others, *[((1 - drawn) * F.col(c) * F.lit(factor) + drawn * F.lit(t)).alias(c) for c, t in zip(SCATTERS, target)])


def _quartiles(rows: DataFrame) -> DataFrame:
    """g, n, and the quartiles q0 to q3 of every dimension."""
    return rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(DIMS)])


def _from_quartiles() -> list[Column]:
    """The centre and the diagonal scatter that the quartiles give."""
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0))
    return [F.col(f"q{i}")[1].alias(m) for i, m in enumerate(MEANS)] + [(spread(i) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS]


def _common_scatter(rows: DataFrame, coverage: float) -> list[float]:
    """The scatter of all rows around their groups' medians, by the minimum covariance determinant: ten numbers."""
    centred = rows.select(F.lit("").alias("g"), F.lit(1).alias("n"), *[(F.col(x) - F.col(f"q{i}")[1]).alias(x) for i, x in enumerate(DIMS)])
    none = [0.0] * len(PAIRS)
    now = workspace.stage(_with_root(_quartiles(centred).select("g", *_from_quartiles())), "outlier-pool")  # one row
    best = now.first()
    if best is None:
        return none
    for _ in range(MAX_STEPS):
        now = _concentrated(centred, now, ["g"], coverage, none, 0.0, True)
        new = now.first()
        if new.log_det > best.log_det - LEAST_FALL:
            break
        best = new
    return [sum(best[f"l{i}{k}"] * best[f"l{j}{k}"] for k in range(j + 1)) - (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS]


def _estimates(rows: DataFrame, coverage: float, prior_rows: float) -> DataFrame:
    """The centre m and root l of every group g, of the least determinant that was found. ``rows`` has g and the vector."""
    quartiles = workspace.stage(_quartiles(rows), "outlier-quartiles")
    few = quartiles.count() * (SUBSETS + 2) <= workspace.SMALL_ROWS
    rows = rows.join(F.broadcast(quartiles) if few else quartiles, "g")
    target = _common_scatter(rows, coverage)
    rows = rows.drop(*[f"q{i}" for i in range(4)])
    # Starts: the quartiles, the common scatter around the median, and random subsets (as a hash of the row says).
    median = quartiles.select("g", "n", *_from_quartiles())
    plain = lambda df, nr: df.select("g", F.lit(nr).alias("start"), *MEANS, *SCATTERS)
    starts = plain(median, 0).unionByName(plain(median.withColumns({c: F.lit(t) for c, t in zip(SCATTERS, target)}), 1))
    nr = F.explode(F.sequence(F.lit(2), F.lit(SUBSETS + 1))).alias("start")
    drawn = rows.select("g", "n", *DIMS, nr).where(F.shiftrightunsigned(F.xxhash64(*DIMS, "start"), 11) * F.lit(2.0**-53) * F.col("n") < SUBSET_ROWS)
    subsets = drawn.groupBy("g", "start").agg(F.count("*").alias("n"), *_moments())
    starts = starts.unionByName(_regularised(subsets, 1.0, target, prior_rows))
    now = workspace.stage(_with_root(starts), "outlier-starts")
    for _ in range(2):
        now = _concentrated(rows, now, ["g", "start"], coverage, target, prior_rows, few)
    least = now.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("least"))
    best = workspace.stage(now.join(least.select("g", "least.start"), ["g", "start"]).drop("start"), "outlier-best")
    live = best
    for _ in range(MAX_STEPS):
        step = _concentrated(rows, live, ["g"], coverage, target, prior_rows, few)
        before = best.select("g", F.col("log_det").alias("before"))
        live = workspace.stage(step.join(before, "g").where(F.col("log_det") < F.col("before") - LEAST_FALL).drop("before"), "outlier-live")
        if live.isEmpty():
            break
        best = workspace.stage(best.join(live.select("g"), "g", "left_anti").unionByName(live), "outlier-best")
    return best


def outlier_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    key: str = "doc_id",
    coverage: float = 0.75,
    cutoff: float = 28.0,
    prior_rows: float = 30.0,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, the base statistics, base_failed, d2 (the squared robust distance; null
    if the base rules fail) and kept. ``cutoff`` 28 is exceeded by one normal vector in 80,000."""
    unknown = "\u0000null"
    group = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in (lang, source)])
    stats = base_statistics(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), group.alias("g")), keep=("doc_id", "g"))
    stats = stats.select("*", base_failed().alias("base_failed"), *[x.alias(n) for x, n in zip(vector(), DIMS)])
    stats = workspace.stage(stats, "outlier-stats")
    estimates = _estimates(stats.where(~F.col("base_failed")).select("g", *DIMS), coverage, prior_rows)
    d2 = F.when(~F.col("base_failed"), _distance())
    return stats.join(workspace.lookup(estimates), "g", "left").select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        d2.alias("d2"), (~F.col("base_failed") & F.coalesce(d2 <= cutoff, F.lit(True))).alias("kept"),
    )
