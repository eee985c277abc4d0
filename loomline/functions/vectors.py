"""Vector expressions on arrays, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector gives 0, null gives null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size.isNotNull(), F.lit(0.0))


def fit(v: Column, dim: int) -> Column:
    """Padded with zeros or cut to ``dim``."""
    return F.slice(F.concat(as_double(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)
