"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymind.llm.common import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one; a component is named by its smallest node.

    Each round makes every node's larger neighbours point to its smallest one, then its smaller neighbours too, until every
    larger end has one edge and no edge ends at it: then each component is a star around its smallest node. Minima
    are combined before each shuffle, and every round is written once to the shared folder, so lineage stays short.
    Rounds grow with the logarithm of the longest chain, not with the size of a component. Nulls and loops are no edges.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = cut_lineage(now, "edges")
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        no_star = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if no_star.count() == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _smallest(large)
        now = (
            large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        now = cut_lineage(now, "small-star")
