"""Vector arithmetic as column expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def _product_sum(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def _comparable(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))


def dot(a: Column, b: Column) -> Column:
    return F.when(_comparable(a, b), _product_sum(a, b)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    return F.when(
        _comparable(a, b), F.coalesce(F.try_divide(_product_sum(a, b), norm(a) * norm(b)), F.lit(0.0))
    ).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; infinity for empty or unequal vectors."""
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(_comparable(a, b), norm(diffs)).otherwise(F.lit(float("inf")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    length = norm(v)
    return F.when(length > 0, F.transform(doubles, lambda x: x / length)).otherwise(doubles)
