"""Scores, distances and probabilities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    inside = F.when(h < 0, 0.0).when(h > 1, 1.0).otherwise(h)  # least() and greatest() would skip a null
    return F.lit(12742.0) * F.asin(F.sqrt(inside))


def log_floor(p: Column, floor: float = 1e-6) -> Column:
    return F.ln(F.greatest(p, F.lit(floor)))


def log1p_positive(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) * idf(n, df)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def coverage(a: Column, b: Column) -> Column:
    """The share of a's elements that b has; 0 if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))).otherwise(0.0)


def rrf(ranks: list[Column], k: int = 60, missing: int = 2001) -> Column:
    return sum((1.0 / (k + F.coalesce(r, F.lit(missing))) for r in ranks[1:]), 1.0 / (k + F.coalesce(ranks[0], F.lit(missing))))


def not_a_number_to(x: Column, default: float) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default))


def three_valued(wanted: Column, have: Column) -> Column:
    """0 without a wish, 1 if it is met, -1 if it isn't."""
    return F.when(F.coalesce(wanted, F.lit("")) == "", 0).when(wanted == have, 1).otherwise(-1)


def mix(x: Column, rep: Column | int = 0, seed: int = 0) -> Column:
    """A documented integer mix in place of a random generator, the same in any SQL: ((x % 2^20) * 1103515 + rep * 12345 + seed) mod 2147483647."""
    rep = rep if isinstance(rep, Column) else F.lit(rep)
    return F.pmod(F.pmod(x.cast("long"), F.lit(1048576)) * 1103515 + rep.cast("long") * 12345 + seed, F.lit(2147483647))
