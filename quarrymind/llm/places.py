"""Gapless places of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymind.llm.common import cut_lineage
from quarrymind.session import small_side

#: monotonically_increasing_id holds the partition above this bit and the row within it below.
PART_BIT = 33


def numbered(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` with ``place`` (0, 1, 2 ... in the group, by ``order``) and ``n`` (rows of the group).

    Rows are ranged over all tasks by group and order, so a hot group is spread; each range is written once with its row numbers, and a
    group's ranges are then added up: one small row for each (group, range). Rows that tie in the whole order stand in any order.
    ``group`` must not be null; ``rows`` must not have columns named place, n, _row, _part, _first or _before.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    written = cut_lineage(ranged.withColumn("_part", F.shiftright("_row", PART_BIT)), label)
    ranges = written.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = small_side(ranges.select(
        group, "_part", (F.col("_first") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).alias("_before"), F.sum("_rows").over(whole).alias("n")
    ))
    placed = written.join(ranges, [group, "_part"]).withColumn("place", F.col("_row") - F.col("_before"))
    return placed.drop("_row", "_part", "_before")
