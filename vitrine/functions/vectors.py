"""Small-vector arithmetic on array columns (one pair per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine kept to nine decimals, so that ties do not hang on summation order.

    A missing or zero vector has cosine 0 with everything.
    """
    length = norm(a) * norm(b)
    value = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.round(value, SCORE_DECIMALS)
