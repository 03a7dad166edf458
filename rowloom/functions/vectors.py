"""Vector expressions on ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector scaled to length one; zero vectors stay zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def mean(vectors: Column) -> Column:
    """Element-wise mean of an ``array<array<double>>``."""
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(vectors))
