"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, keep: list[Column | str], array: Column | str, item: str, pos: str | None = None) -> DataFrame:
    """One row per array element; rows with an empty or null array are left out.

    For a plain explode Spark first filters on the array's size, which evaluates a computed
    array again for that test. The outer form is evaluated once, and empty arrays drop out after.
    """
    place = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)
