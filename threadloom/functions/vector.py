"""Column expressions over array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms of 1e-8 at least, so that a zero vector has 0 with all."""
    return dot(a, b) / (norm(a) * norm(b))
