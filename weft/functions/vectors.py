"""Array and set expressions: distances, nearest centroid, Jaccard, approximate equality, collision probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distances_to(point: Column, centroids: Column) -> Column:
    return F.transform(centroids, lambda c: squared_distance(point, c))


def nearest(distances: Column) -> Column:
    """Position from 0 of the smallest; the first of equals."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Null for two empty sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def all_close(a: Column, b: Column, atol: float, rtol: float = 1e-5) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), lambda ok: ok)


def collision_probability(similarity: Column, hashes: int, bands: Column) -> Column:
    """Chance that sets of this similarity share a band."""
    rows = F.lit(float(hashes)) / bands
    return 1 - F.pow(1 - F.pow(similarity, rows), bands)


def multi_hot(found: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(found, v).cast("int"))
