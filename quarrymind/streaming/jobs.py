"""Streams over landed rows: signals, metrics, sessions, edge weights, periods, learners, files.

A job has a folder that holds its checkpoint and its changes, one folder per trigger. A trigger that is run again replaces its own
folder, and a job that is started again with the same folder goes on where it stopped. Tables are read from the changes:
sums and folded steps of all triggers, or the newest row of each key. How much a trigger takes is set at the
source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.operators import feedback as fb
from quarrymind.operators import graph, learners
from quarrymind.session import ROCKSDB_PROVIDER, scratch_path
from quarrymind.sources import ingest as ig
from quarrymind.streaming.state import conversation_windows


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Process what has landed since the checkpoint, one ``write`` per trigger; returns the last trigger's number.

    ``write`` has to use its rows in one action only, or the plan behind them, state included, would run again.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    started = (
        stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    started.awaitTermination()
    done = started.lastProgress
    return done["batchId"] if done else -1


def record(stream: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> int:
    """Write what ``step`` makes of each trigger's rows (the rows themselves without it) to the job's changes."""
    step = step or (lambda batch: batch)
    return run_available(
        stream, lambda batch, i: step(batch).write.mode("overwrite").parquet(f"{folder}/changes/batch={i}"), f"{folder}/checkpoint", mode
    )


def changes(empty: DataFrame, folder: str) -> DataFrame:
    """All changes of a job with the number of their trigger; ``empty`` has their columns."""
    spark, marked = empty.sparkSession, empty.withColumn("batch", F.lit(0).cast("long"))
    try:
        return spark.read.schema(marked.schema).parquet(f"{folder}/changes")
    except AnalysisException:  # nothing has landed yet
        return marked.limit(0)


def _none_of(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def latest_per_key(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run a keyed stream over what has landed and return the newest row per key."""
    folder = folder or scratch_path(stream.sparkSession, "keyed")
    record(stream, folder, mode="update")
    rest = [c for c in stream.columns if c not in keys]
    newest = changes(_none_of(stream), folder).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in stream.columns])


def append_all(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what has landed and return all rows it ever gave."""
    folder = folder or scratch_path(stream.sparkSession, "appended")
    record(stream, folder)
    return changes(_none_of(stream), folder).drop("batch")


def totals(
    stream: DataFrame, parts: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> DataFrame:
    """Record what each trigger adds to its keys, and merge what all triggers have added.

    Parts are plain aggregates of one trigger, so there is no keyed state and no key's rows are ever listed.
    """
    folder = folder or scratch_path(stream.sparkSession, "totals")
    record(stream, folder, parts)
    return merge(changes(parts(_none_of(stream)), folder))


# ---------------------------------------------------------------- the streams

def signals_stream(raw: DataFrame) -> DataFrame:
    """Parsed and scored signals; stateless."""
    return fb.parse_signals(raw)


def chunk_metrics_stream(feedback: DataFrame, folder: str | None = None, tie: str = "feedback_id") -> DataFrame:
    """Running score and counts per chunk: ``feedback(feedback_id, ts, overall_score, chunk_ids)``."""
    return totals(feedback, lambda batch: fb.chunk_parts(batch, tie=tie), lambda parts: fb.chunk_metrics_of(parts, "batch"), folder)


def concept_metrics_stream(signals: DataFrame, folder: str | None = None) -> DataFrame:
    """Confusion and satisfaction per concept by the rule of :func:`feedback.concept_metrics`; a query whose signals
    come in several triggers is one report."""
    return totals(signals, lambda batch: fb.concept_parts(fb.parse_signals(batch)), lambda parts: fb.concept_metrics_of(parts.drop("batch")), folder)


def session_stream(turns: DataFrame, **limits) -> DataFrame:
    return conversation_windows(turns.select("session_id", "turn_no", "token_count", "concepts"), **limits)


def edge_update_stream(feedback: DataFrame, edges: DataFrame, folder: str | None = None) -> DataFrame:
    """The edges after all feedback that has ever landed; a trigger records one folded step per link it names."""
    step = lambda batch: graph.fold_updates(graph.edge_updates(batch))
    return totals(feedback, step, lambda parts: graph.apply_folded(edges, graph.merge_folded(parts)), folder)


def period_metrics_stream(feedback: DataFrame, period: str = "7 days", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Feedback totals per sliding period; rows later than ``lateness`` are dropped and counted by Spark."""
    return (
        feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        .groupBy(F.window("ts", period, slide).alias("w"))
        .agg(
            F.count("*").alias("total_feedback"), F.avg("overall_score").alias("average_score"),
            F.count_if(F.col("overall_score") >= 0.6).alias("positive"), F.count_if(F.col("overall_score") <= 0.4).alias("negative"),
        )
        .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "total_feedback", "average_score", "positive", "negative")
    )


def mastery_stream(interactions: DataFrame, folder: str | None = None) -> DataFrame:
    """Running mastery per student and concept."""
    return totals(interactions, learners.mastery_parts, lambda parts: learners.mastery_of(parts, "batch"), folder)


def profile_stream(interactions: DataFrame, folder: str | None = None) -> DataFrame:
    """Running question counts and answer quality per student."""
    return totals(interactions, learners.profile_parts, lambda parts: learners.profiles_of(parts, "batch"), folder)


def ingest_stream(docs: DataFrame, base: str, key: str = "source_id", **options) -> int:
    """Ingest landed documents; each trigger is a version of its sources (see :func:`ingest.write_ingested`)."""
    return run_available(docs, lambda batch, i: ig.write_ingested(ig.ingest(batch, key, **options), base, i), f"{base}/checkpoint")
