"""Row upkeep of stored tables: upsert, partial update, deletion, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.session import small_side

# Model limits as (model, provider, context window, most output, default output).
MODELS = [
    ("gpt-5.2", "openai", 400_000, 32_768, 4_096),
    ("gpt-5", "openai", 400_000, 32_768, 4_096),
    ("gpt-5-mini", "openai", 400_000, 16_384, 4_096),
    ("gpt-5-nano", "openai", 400_000, 8_192, 2_048),
    ("gpt-4.1", "openai", 1_047_576, 32_768, 4_096),
    ("gpt-4.1-mini", "openai", 1_047_576, 16_384, 4_096),
    ("gpt-4.1-nano", "openai", 1_047_576, 8_192, 2_048),
    ("gpt-4o", "openai", 128_000, 16_384, 4_096),
    ("gpt-4o-mini", "openai", 128_000, 16_384, 4_096),
    ("gpt-3.5-turbo", "openai", 16_385, 4_096, 2_048),
    ("gemini-3-pro-preview", "google", 1_000_000, 32_768, 4_096),
    ("gemini-3-flash-preview", "google", 1_000_000, 16_384, 4_096),
    ("gemini-2.5-pro", "google", 250_000_000, 32_768, 4_096),
    ("gemini-2.5-flash", "google", 250_000_000, 32_768, 4_096),
    ("gemini-2.5-flash-lite", "google", 250_000_000, 32_768, 4_096),
    ("gemini-2.0-pro", "google", 1_000_000, 8_192, 4_096),
    ("gemini-2.0-flash", "google", 1_000_000, 8_192, 4_096),
    ("gemini-2.0-flash-lite", "google", 1_000_000, 8_192, 2_048),
    ("gemini-pro", "google", 32_768, 8_192, 2_048),
    ("gemini-1.5-pro", "google", 2_000_000, 8_192, 4_096),
    ("gemini-1.5-flash", "google", 1_000_000, 8_192, 4_096),
    ("gemma-3-27b-it", "google", 12_000, 4_096, 2_048),
    ("gemma-4-31b-it", "google", 256_000, 32_768, 4_096),
]


def model_limits(spark: SparkSession, provider: str | None = None) -> DataFrame:
    """The known models, of one provider if given."""
    schema = "model string, provider string, context_window long, max_output_tokens long, default_max_output long"
    known = spark.createDataFrame(MODELS, schema)
    return known if provider is None else known.where(F.col("provider") == provider)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of both tables; a change wins a tie.

    The newest row is a partial aggregate, so a key changed very often shrinks map-side.
    """
    cols = [c for c in base.columns if c not in keys]
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.select(*base.columns).withColumn("_side", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(version, "_side")).alias("r"))
    return newest.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in base.columns])


def merge_update(base: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Base rows with the non-null values of their changes; the latest non-null one by ``version``."""
    cols = [c for c in changes.columns if c not in keys and c != version]
    order = F.col(version) if version else F.lit(0)
    last = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in cols])
    joined = base.join(last, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after removing ``ids(node_id)`` and every edge that touches them."""
    gone = small_side(ids.select("node_id").distinct())
    left = edges.join(gone, edges["src"] == gone["node_id"], "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.join(gone, left["dst"] == gone["node_id"], "left_anti")


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(small_side(keys.select("src", "edge_type", "dst").distinct()), ["src", "edge_type", "dst"], "left_anti")


def list_sources(sources: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """Stored sources, finished runs not stored yet, and open runs; newest first, with the total.

    ``runs(run_id, source_id, status, message, chunks_created, started_at, completed_at)``.
    """
    stored = sources.select(
        "source_id", F.coalesce("title", F.lit("Sin título")).alias("title"), F.coalesce("content_type", F.lit("text")).alias("source_type"),
        F.lit("completed").alias("status"), F.coalesce("total_chunks", F.lit(0)).cast("long").alias("chunk_count"), "created_at",
    )
    done = runs.where((F.col("status") == "completed") & F.col("source_id").isNotNull()).join(stored, "source_id", "left_anti").select(
        "source_id", F.replace("message", F.lit("Completado: "), F.lit("")).alias("title"), F.lit("file").alias("source_type"),
        F.lit("completed").alias("status"), F.col("chunks_created").cast("long").alias("chunk_count"), F.col("completed_at").alias("created_at"),
    )
    open_runs = runs.where(F.col("status").isin("pending", "processing")).select(
        F.col("run_id").alias("source_id"), F.col("message").alias("title"), F.lit("file").alias("source_type"), "status",
        F.lit(0).cast("long").alias("chunk_count"), F.col("started_at").alias("created_at"),
    )
    every = stored.unionByName(done).unionByName(open_runs)
    total = every.agg(F.count("*")).scalar()
    return every.orderBy(F.col("created_at").desc_nulls_last(), "source_id").limit(limit).withColumn("total", total)


def list_runs(runs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    kept = runs if status is None else runs.where(F.col("status") == status)
    return kept.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(limit)


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def check_token_budget(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Whether each request fits its model; unknown models pass.

    ``models(model, provider, context_window, max_output_tokens, default_max_output)``.
    """
    total = F.col("input_tokens") + F.col("output_tokens")
    window = F.col("context_window")
    reserved = F.when(F.col("output_tokens") > 0, F.col("output_tokens")).otherwise(F.coalesce("default_max_output", F.lit(4096)))
    status = (
        F.when(window.isNull(), "unknown_model").when(total > window, "exceeds_context")
        .when(F.col("output_tokens") > F.col("max_output_tokens"), "exceeds_output").otherwise("ok")
    )
    held = F.coalesce(window, F.lit(128_000))
    return (
        requests.join(models, "model", "left")
        .withColumn("status", status)
        .withColumn("valid", F.col("status").isin("ok", "unknown_model"))
        .withColumn("available", held - total)
        .withColumn("safe_limit", held - reserved - F.floor(held * 0.05))
    )
