"""Dense-vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Σ aᵢ·bᵢ (JVM-side higher-order functions)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """dot/(|a||b|); NULL when either norm is zero. Scale-invariant."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)
