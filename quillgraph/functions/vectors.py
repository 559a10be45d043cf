"""Vector expressions over ``array<float>``; sums are double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0) | n.isNull(), 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column, eps: float = 1e-12) -> Column:
    n = norm(a)
    return F.when(n > eps, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)
