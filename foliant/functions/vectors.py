"""Column builders over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector is null or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b), n)))


def offline_embedding(text: Column, dim: int = 384) -> Column:
    """A unit vector that depends on the text alone; zeros for blank text. Stands in for a provider."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(text) + i * 31, F.lit(10_000)) / 5000.0 - 1.0)
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, zero).otherwise(F.transform(raw, lambda x: x / norm(raw)))
