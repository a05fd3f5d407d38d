"""Vector functions as Column expressions, in double precision and a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.reduce(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.reduce(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Contribution of a 1-based rank to reciprocal-rank fusion."""
    return 1.0 / (F.lit(k) + rank)
