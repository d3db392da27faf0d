"""Vector functions as column expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, epsilon: float = 0.0) -> Column:
    """The vector over its norm; a zero vector stays zero. With ``epsilon`` it is added to the norm instead."""
    n = norm(a) + epsilon
    return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(a)).alias("n")), lambda z: z["v"] / z["n"])


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised_similarity(cos: Column, average: Column) -> Column:
    """How far a similarity lies above the average, as a share of it; 0 if the average is 0."""
    return F.when(average == 0, 0.0).otherwise((cos - average) / F.when(average == 0, 1.0).otherwise(average))


def mean_pool(vectors: Column) -> Column:
    """The mean, position by position, of a list of vectors."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))
