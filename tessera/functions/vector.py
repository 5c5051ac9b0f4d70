"""Vector column expressions (MTH-1..4). Row-wise forms; the batched scorer is
``tessera.operators.knn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot_product(a, b) -> Column:
    """MTH-2: sum of element products, in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda s, v: s + v,
    )


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """MTH-1: unit vector (a zero vector stays zero)."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def cosine_eps(a, b, eps: float = 1e-9) -> Column:
    """MTH-3: dot / (|a| |b| + eps)."""
    return dot_product(a, b) / (l2_norm(a) * l2_norm(b) + F.lit(eps))


def clamped_boost(score, boost) -> Column:
    """MTH-4: min(1.0, score + boost)."""
    return F.least(F.lit(1.0), _c(score) + _c(boost))
