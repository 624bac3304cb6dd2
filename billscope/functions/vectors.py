"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work a value out once and use it; inside a lambda it would be redone per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    return bound(
        norm(a), lambda size: F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    )


def length_weights(parts: Column) -> Column:
    """Character lengths of the parts as shares of their sum."""
    lengths = F.transform(parts, lambda p: F.length(p).cast("double"))
    total = F.aggregate(lengths, F.lit(0.0), lambda s, n: s + n)
    return bound(total, lambda t: F.transform(lengths, lambda n: F.when(t > 0, n / t)))
