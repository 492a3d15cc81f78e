"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column, tolerance: float = 0.0) -> Column:
    """Unit length; vectors within ``tolerance`` of it stay as they are."""
    n = norm(v)
    return F.when(F.abs(n - 1) <= tolerance, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_problem(v: Column, dims: int) -> Column:
    """Why a vector can't be stored; null for a sound one."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != dims, "dimensions").when(bad, "not finite").when(norm(v) == 0, "zero")


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct word ``k``-grams; fewer words make one."""

    # The words are a lambda's variable, so that they are found once and not for each gram.
    def grams(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))))

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), grams)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
