"""Vector expressions over array columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import col


def doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where lengths differ or a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(col(a)) == F.size(col(b))) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def fit_length(v: Column | str, n: int) -> Column:
    """Padded with zeros, or cut, to n components."""
    return F.slice(F.concat(F.coalesce(doubles(v), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def is_zero(v: Column | str) -> Column:
    return F.forall(doubles(v), lambda x: x == 0.0)


def hashed_embedding(text: Column | str, n: int = 64) -> Column:
    """Deterministic stand-in for a provider: signed counts of hashed words, scaled to length 1; blank text is all zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cell = lambda w: F.pmod(F.xxhash64(w), F.lit(n))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.filter(words, lambda w: cell(w) == i), F.lit(0.0), lambda s, w: s + sign(w)))
    scale = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(scale > 0, x / scale).otherwise(0.0))
