"""Vector functions as Column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def score(cos: Column) -> Column:
    """Cosine mapped to 0 to 1, as vector indexes report it."""
    return (1 + cos) / 2


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
