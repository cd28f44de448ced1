"""Array expressions: vectors, boxes, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(v: Column, dimension: int) -> Column:
    """The right size, all finite, and not all zeros."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0)


def overlaps(a: str, b: str) -> Column:
    """Whether boxes (struct columns x0, y0, x1, y1) have an area in common."""
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{b}.y0") < F.col(f"{a}.y1"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
