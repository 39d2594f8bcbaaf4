"""Vectors as arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ."""
    s = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalized(v: Column) -> Column:
    """A zero vector stays."""
    n = norm(v)
    return F.transform(_double(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def truncated(v: Column, dims: int) -> Column:
    """The first dims of a nested embedding, of unit length again."""
    return normalized(F.slice(v, 1, dims))
