"""Reuse of stored answers and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.operators.ranking import as_of, first_per_key
from quarrymind.session import small_side

ANSWER_TTL, EMBEDDING_TTL = 3600, 86400


def reuse_key(text: Column, tenant: Column, context: dict[str, Column] | None = None) -> Column:
    """Sixteen hex digits naming a request: its lower-cased text, tenant and given context."""
    fields = {"query": F.lower(F.trim(text)), "database": tenant.cast("string"), **(context or {})}
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 16)


def with_answer_key(queries: DataFrame, text: str = "text", tenant: str = "tenant", context: list[str] | None = None) -> DataFrame:
    """Add ``answer_key``; of the context only level, concepts and session count."""
    named = {c: F.col(c) for c in (context or []) if c in ("student_level", "concepts", "session_id")}
    return queries.withColumn("answer_key", reuse_key(F.col(text), F.col(tenant), named))


def answer_tags(answers: DataFrame) -> DataFrame:
    """Add one tag per concept to the answers' own tags."""
    own = F.col("tags") if "tags" in answers.columns else F.array().cast("array<string>")
    return answers.withColumn("tags", F.concat(own, F.transform("concepts", lambda c: F.concat(F.lit("concept:"), c.cast("string")))))


def reuse_answers(queries: DataFrame, answers: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Each query with the newest answer under its key, if that is still within its lifetime.

    ``queries(answer_key, ts, …)``, ``answers(answer_key, created_at, ttl_seconds, …)``. A
    newer answer replaces an older one even when it expires sooner; a lifetime of zero or
    less never ends. Adds ``from_cache``.
    """
    payload = payload or ["answer"]
    tie = "answer_id" if "answer_id" in answers.columns else payload[0]
    found = as_of(queries, answers, ["answer_key"], "ts", "created_at", [*payload, "ttl_seconds"], tie)
    alive = F.col("created_at").isNotNull() & (
        (F.col("ttl_seconds") <= 0) | (F.col("ts") <= F.col("created_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)")))
    )
    hit = F.coalesce(alive, F.lit(False))
    return found.select(
        *queries.columns, *[F.when(hit, F.col(c)).alias(c) for c in payload], hit.alias("from_cache")
    )


def invalidate(
    answers: DataFrame, keys: DataFrame | None = None, tags: list[str] | None = None, concepts: list | None = None,
    documents: list | None = None,
) -> DataFrame:
    """Answers left after dropping the given keys and everything with one of the tags."""
    left = answers
    if keys is not None:
        left = left.join(small_side(keys.select("answer_key").distinct()), "answer_key", "left_anti")
    gone = [*(tags or []), *[f"concept:{c}" for c in concepts or []], *[f"doc:{d}" for d in documents or []]]
    if gone:
        left = left.where(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in gone])))
    return left


def reuse_stats(reused: DataFrame, tenant: str = "tenant") -> DataFrame:
    hits = F.count_if("from_cache")
    return reused.groupBy(tenant).agg(
        hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.try_divide(hits, F.count("*")).alias("hit_rate")
    )


def reuse_embeddings(df: DataFrame, stored: DataFrame, text: str = "text", tenant: str = "tenant", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Split rows into those with a stored embedding not older than its lifetime, and the rest.

    ``stored(emb_key, embedding, created_at, ttl_seconds)``; the newest row per key counts.
    """
    keyed = df.withColumn("emb_key", reuse_key(F.col(text), F.col(tenant)))
    newest = first_per_key(stored, ["emb_key"], [F.col("created_at").desc()])
    ttl = F.coalesce("ttl_seconds", F.lit(EMBEDDING_TTL))
    joined = keyed.join(newest, "emb_key", "left").withColumn(
        "_fresh",
        F.coalesce(F.col("created_at").isNotNull() & (F.timestamp_diff("SECOND", F.col("created_at"), F.col(ts)) <= ttl), F.lit(False)),
    )
    hits = joined.where("_fresh").select(*df.columns, "emb_key", "embedding")
    misses = joined.where("not _fresh").select(*df.columns, "emb_key")
    return hits, misses
