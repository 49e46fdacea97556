"""Conversation sessions: context windows, active concepts, summaries, export and import."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quarrymind.operators.ranking import number_rows, top_k

MAX_TURNS, MAX_TOKENS, KEEP_LAST, ACTIVE = 20, 4000, 2, 10


def _suffix(turns: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` turns per session, with age from 1 and tokens from the newest on.

    Only these rows are shuffled; the token sum then runs over at most ``limit`` rows.
    """
    newest = top_k(turns, ["session_id"], [F.col("turn_no").desc()], limit, "_age")
    running = Window.partitionBy("session_id").orderBy("_age").rowsBetween(Window.unboundedPreceding, 0)
    return newest.withColumn("_used", F.sum("token_count").over(running))


def recent_context(turns: DataFrame, max_turns: int = MAX_TURNS, max_tokens: int = MAX_TOKENS, include_system: bool = False) -> DataFrame:
    """Newest turns that fit both limits, stopping at the first that does not."""
    spoken = turns if include_system else turns.where(F.col("role") != "system")
    return _suffix(spoken, max_turns).where(F.col("_used") <= max_tokens).drop("_age", "_used")


def context_messages(turns: DataFrame, max_tokens: int = 2000, max_turns: int = MAX_TURNS) -> DataFrame:
    """Recent context per session as an ordered list of (role, content)."""
    kept = recent_context(turns, max_turns, max_tokens)
    return kept.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("turn_no", "role", "content"))).alias("m")
    ).select("session_id", F.transform("m", lambda t: F.struct(t["role"], t["content"])).alias("messages"))


def retained_turns(turns: DataFrame, max_turns: int = MAX_TURNS, max_tokens: int = MAX_TOKENS, keep_last: int = KEEP_LAST) -> DataFrame:
    """Turns still held after every insert pruned the oldest ones.

    An insert keeps the new turn and, over budget, at least the ``keep_last`` before it. The
    oldest turn kept never moves back, so what is held at the end depends on the newest
    turns only: those within the budget or the guaranteed few.
    """
    held = _suffix(turns, max_turns)
    return held.where((F.col("_used") <= max_tokens) | (F.col("_age") <= keep_last + 1)).drop("_age", "_used")


def active_concepts(turns: DataFrame, n: int = ACTIVE) -> DataFrame:
    """Concepts in first-seen order, cut to the last ``n`` after every turn.

    What leaves the list may return later, so the rule needs each session's turns in order.
    Turns arrive sorted and in Arrow batches; a task holds one list of ``n`` per session,
    never a session.
    """
    kind = turns.schema["concepts"].dataType
    out = T.StructType([turns.schema["session_id"], T.StructField("concepts", kind)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, started = None, [], False
        for batch in batches:
            done_ids, done_lists = [], []
            for session, concepts in zip(batch.column("session_id").to_pylist(), batch.column("concepts").to_pylist()):
                if started and session != current:
                    done_ids.append(current)
                    done_lists.append(held)
                    held = []
                current, started = session, True
                if concepts:
                    for concept in concepts:
                        if concept not in held:
                            held.append(concept)
                    held = held[-n:]
            if done_ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done_ids, batch.schema.field("session_id").type), pa.array(done_lists, batch.schema.field("concepts").type)],
                    names=["session_id", "concepts"],
                )
            types = [batch.schema.field(c).type for c in ("session_id", "concepts")]
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([current], types[0]), pa.array([held], types[1])], names=["session_id", "concepts"])

    ordered = turns.select("session_id", "turn_no", "concepts").repartition("session_id").sortWithinPartitions("session_id", "turn_no")
    return ordered.select("session_id", "concepts").mapInArrow(walk, out)


def related_turns(turns: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """Turns sharing most concepts with ``wanted(session_id, wanted_concepts)``, earlier turns first on ties."""
    overlap = F.size(F.array_intersect("concepts", "wanted_concepts"))
    scored = turns.join(wanted, "session_id").withColumn("overlap", overlap).where(F.col("overlap") > 0)
    return top_k(scored, ["session_id"], [F.col("overlap").desc(), F.col("turn_no")], k).drop("wanted_concepts")


def summarize_sessions(turns: DataFrame, n: int = 10, lines: int = 5, cut: int = 100) -> DataFrame:
    """Sessions longer than ``n`` turns: the oldest ``n`` become one summary turn before the rest."""
    numbered = number_rows(turns, ["session_id"], F.floor(F.col("turn_no") / 1000), [F.col("turn_no")], "_pos")
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("_size"))
    placed = numbered.join(sizes, "session_id")
    old = placed.where((F.col("_size") > n) & (F.col("_pos") <= n))
    line = F.when(F.col("role") == "user", F.concat(F.lit("- User asked about: "), F.substring("content", 1, cut), F.lit("..."))).when(
        F.col("role") == "assistant", F.concat(F.lit("- Assistant explained: "), F.substring("content", 1, cut), F.lit("..."))
    )
    # At most n rows per session reach this aggregate.
    text = F.array_join(F.slice(F.array_compact(F.transform("_t", lambda t: t["line"])), 1, lines), "\n")
    union_of = lambda f: F.sort_array(F.array_distinct(F.flatten(F.transform("_t", lambda t: t[f]))))
    summary = (
        old.groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn_no", line.alias("line"), "concepts", "chunks_used"))).alias("_t"), F.min("turn_no").alias("turn_no"))
        .select(
            "session_id", "turn_no", F.lit("system").alias("role"),
            F.concat(F.lit("[Conversation Summary]\n"), text).alias("content"),
            union_of("concepts").alias("concepts"), union_of("chunks_used").alias("chunks_used"), F.lit(True).alias("is_summary"),
        )
        .withColumn("token_count", F.floor(F.length("content") / 4).cast("int"))
    )
    rest = placed.where((F.col("_size") <= n) | (F.col("_pos") > n)).select(
        "session_id", "turn_no", "role", "content", "concepts", "chunks_used", F.lit(False).alias("is_summary"), "token_count"
    )
    return summary.unionByName(rest)


def session_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(
        F.count("*").alias("total_turns"), F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.sum("token_count").alias("total_tokens"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"),
    )


def suggestions(turns: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` active concepts per session as follow-up topics."""
    return active_concepts(turns).select("session_id", F.slice("concepts", 1, k).alias("topics"))


_TURN = ["turn_no", "ts", "role", "content", "concepts", "chunks_used", "token_count"]


def export_sessions(turns: DataFrame, max_turns: int = MAX_TURNS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One JSON document per session with its held turns; at most ``max_turns`` each."""
    held = retained_turns(turns, max_turns, max_tokens)
    return held.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct(*_TURN))).alias("turns"), F.sum("token_count").alias("total_tokens"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"),
    ).select("session_id", F.to_json(F.struct("session_id", "turns", "total_tokens", "created_at", "last_activity")).alias("json"))


def import_sessions(exported: DataFrame, turn_type: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Turns and per-session totals from exported JSON; tokens are summed again."""
    schema = T.StructType([
        T.StructField("session_id", turn_type["session_id"].dataType),
        T.StructField("turns", T.ArrayType(T.StructType([turn_type[c] for c in _TURN]))),
    ])
    turns = exported.select(F.from_json("json", schema).alias("j")).select("j.session_id", F.explode("j.turns").alias("t")).select(
        "session_id", *[F.col("t")[c].alias(c) for c in _TURN]
    )
    return turns, turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("token_count").alias("total_tokens"))
