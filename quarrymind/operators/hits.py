"""Shaping of retrieval hits: metadata fields, type filter, exercise listings, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.functions.text import strip
from quarrymind.operators.ranking import top_k


def _field(*paths: str) -> Column:
    """First non-empty metadata field."""
    return F.coalesce(*[F.nullif(F.get_json_object("metadata", f"$.{p}"), F.lit("")) for p in paths])


def to_hits(rows: DataFrame) -> DataFrame:
    """Add chunk type, source and concepts from the JSON ``metadata``, with fallbacks."""
    return rows.withColumns({
        "content": F.coalesce("content", F.lit("")),
        "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
        "chunk_type": F.coalesce(_field("chunk_type", "type"), F.lit("chunk")),
        "source_id": F.coalesce(_field("source", "source_id"), F.lit("")),
        "concepts": F.coalesce(F.from_json(F.get_json_object("metadata", "$.concepts"), "array<string>"), F.array().cast("array<string>")),
    })


def filter_chunk_type(hits: DataFrame, wanted: Column, strict: Column | bool = False, keys: list[str] | None = None) -> DataFrame:
    """Keep hits of the wanted type; a null type keeps all.

    Unless strict, a query (or ``keys`` group) whose filter would leave nothing keeps
    everything. One flag per group is joined back.
    """
    keys = keys or ["query_id"]
    marked = hits.withColumn("_match", F.coalesce(F.col("chunk_type") == wanted, F.lit(False)))
    flags = marked.groupBy(*keys).agg(F.max("_match").alias("_any"))
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    return marked.join(flags, keys).where(wanted.isNull() | F.col("_match") | (~strict & ~F.col("_any"))).drop("_match", "_any")


def exercise_listing(hits: DataFrame, k: int | Column = 10) -> DataFrame:
    """Exercises without their content: id, title, difficulty, concepts; the first ``k`` per query."""
    line = strip(F.get(F.split(strip("content"), "\n"), F.lit(0)))
    first_line = F.when(F.length(line) > 0, F.substring(line, 1, 80)).otherwise(F.lit("Sin título"))
    listed = top_k(hits.where(F.col("chunk_type") == "exercise"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    return listed.withColumns({
        "exercise_id": F.coalesce(_field("exercise_id"), F.col("doc_id").cast("string")),
        "exercise_title": F.coalesce(_field("title"), first_line),
        "difficulty": F.coalesce(F.get_json_object("metadata", "$.difficulty"), F.lit("medium")),
    }).withColumn("content", F.lit(""))


def seed_concepts(hits: DataFrame, found: DataFrame, limit: int = 5, first: int = 5) -> DataFrame:
    """Starting concepts per query: record ids named by its first hits, then those found by text.

    ``hits(query_id, position, concepts)``, ``found(query_id, node_id, rank)``; distinct, in order.
    """
    named = hits.where(F.col("position") <= first).select(
        "query_id", "position", F.posexplode("concepts").alias("i", "node_id")
    ).where(F.contains("node_id", F.lit(":")))
    listed = named.select("query_id", "node_id", F.struct(F.lit(0).alias("s"), F.col("position").cast("int").alias("p"), "i").alias("o")).unionByName(
        found.select("query_id", F.col("node_id").cast("string").alias("node_id"), F.struct(F.lit(1).alias("s"), F.col("rank").cast("int").alias("p"), F.lit(0).alias("i")).alias("o"))
    )
    once = listed.groupBy("query_id", "node_id").agg(F.min("o").alias("o"))
    return top_k(once, ["query_id"], [F.col("o")], limit).select("query_id", "node_id", "rank")
