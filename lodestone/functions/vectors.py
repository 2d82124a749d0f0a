"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM, LEAST_MASK = 1e-12, 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Divided by the norm, which counts as LEAST_NORM at least."""
    n = F.greatest(norm(a), F.lit(LEAST_NORM))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def mean_pool(tokens: Column, mask: Column, dimensions: int) -> Column:
    """Mean of an array of token vectors where mask (array of 0 and 1) is set."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(LEAST_MASK))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    summed = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(summed, lambda x: x / total)
