"""Streams run over the given tables as landed files; results equal the batch rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymind.catalog import common as cm
from quarrymind.catalog.documents import WORDS, normalize_sql
from quarrymind.catalog.learning import BASE, CONCEPTS_SQL, MASTERY_SQL, MIXED_SQL, PROFILE_SQL, RETAIN_SQL, SCORED_SQL, scored_of
from quarrymind.session import scratch_path
from quarrymind.sources import ingest as ig
from quarrymind.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def landed(spark, sf_dir, name):
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}*.parquet")


def _signals(spark, sf_dir):
    raw = cm.signals_of(landed(spark, sf_dir, "events"))
    return raw.withColumn("signal_type", F.when(F.col("signal_id") % 97 == 0, "wave").otherwise(F.col("signal_type")))


def _feedback(spark, sf_dir):
    n_parts, n_docs = (cm.table(spark, sf_dir, t).count() for t in ("part", "documents"))
    return scored_of(landed(spark, sf_dir, "events"), n_parts, n_docs)


@query("signals_stream", cm.with_ctes(*BASE) + "select signal_id, signal_type, round(value, 6) as value, polarity, confidence from parsed")
def signals_stream(spark, sf_dir):
    parsed = jobs.signals_stream(_signals(spark, sf_dir)).select("signal_id", "signal_type", "value", "polarity", "confidence")
    return jobs.append_all(parsed).withColumn("value", F.round("value", 6))


@query("chunk_metrics_stream", cm.with_ctes(SCORED_SQL) + """,
m as (select doc as chunk_id, count(*) as total_feedback, count(*) filter (s >= 0.6) as positive_feedback,
   sum(0.3 * pow(0.7, age) * s) + pow(0.7, count(*)) * 0.5 as a
  from (select doc, f.overall_score as s, row_number() over (partition by doc order by f.ts desc, feedback_id desc) - 1 as age from steps join sf f using (feedback_id)) group by 1)
select chunk_id, total_feedback, positive_feedback, round(a, 6) as average_score, a < 0.4 as needs_review from m""")
def chunk_metrics_stream(spark, sf_dir):
    return jobs.chunk_metrics_stream(_feedback(spark, sf_dir)).select(
        "chunk_id", "total_feedback", "positive_feedback", cm.r6("average_score"), "needs_review"
    )


@query("concept_metrics_stream", cm.with_ctes(*BASE, CONCEPTS_SQL) + """
select concept_id, total_queries, unique_students, round(average_satisfaction, 6) as average_satisfaction, round(confusion_score, 6) as confusion_score
from concept_metrics join students using (concept_id)""")
def concept_metrics_stream(spark, sf_dir):
    return jobs.concept_metrics_stream(_signals(spark, sf_dir)).select(
        "concept_id", "total_queries", "unique_students", cm.r6("average_satisfaction"), cm.r6("confusion_score")
    )


@query("session_stream", "with recursive " + ",\n".join([cm.TURNS_SQL, RETAIN_SQL]) + """
select session_id, string_agg(turn_no::varchar, '|' order by turn_no) as turns, sum(token_count)::bigint as total_tokens
from num join fin using (session_id) where i >= first group by 1""")
def session_stream(spark, sf_dir):
    c = landed(spark, sf_dir, "conversations")
    turns = c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), F.floor(F.length("text") / 4).alias("token_count"),
        F.array((F.col("conv_id") * 7 + F.col("turn")) % 15, (F.col("conv_id") + F.col("turn") * 3) % 15).alias("concepts"),
    )
    held = jobs.latest_per_key(jobs.session_stream(turns, max_turns=4, max_tokens=300), ["session_id"])
    return held.select("session_id", F.array_join(F.transform("turns", lambda t: t.cast("string")), "|").alias("turns"), "total_tokens")


@query("edge_update_stream", "with recursive " + ",\n".join([cm.EDGES_SQL, SCORED_SQL]) + ",\n" + MIXED_SQL)
def edge_update_stream(spark, sf_dir):
    edges = cm.edges(spark, sf_dir)
    return jobs.edge_update_stream(_feedback(spark, sf_dir), edges).select("edge_type", "src", "dst", cm.r6("weight"), "negative_signals")


@query("period_metrics_stream", cm.with_ctes(SCORED_SQL) + """,
w as (select date_trunc('day', ts) - interval 1 day * d as period_start, overall_score as s from sf, range(0, 7) r(d))
select strftime(period_start, '%Y-%m-%d') as period_start, count(*) as total_feedback, round(avg(s), 6) as average_score,
  count(*) filter (s >= 0.6) as positive, count(*) filter (s <= 0.4) as negative from w group by 1""")
def period_metrics_stream(spark, sf_dir):
    periods = jobs.period_metrics_stream(_feedback(spark, sf_dir))
    return jobs.latest_per_key(periods, ["period_start", "period_end"]).select(
        F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "total_feedback", cm.r6("average_score"), "positive", "negative"
    )


@query("mastery_stream", cm.with_ctes(cm.INTERACTIONS_SQL, MASTERY_SQL) + """
select student_id, concept_id, round(mastery_score, 6) as mastery_score, interactions, is_weakness from student_concept""")
def mastery_stream(spark, sf_dir):
    rows = cm.interactions_of(landed(spark, sf_dir, "events"))
    return jobs.mastery_stream(rows).select(
        "student_id", "concept_id", cm.r6("mastery_score"), "interactions", "is_weakness"
    )


@query("profile_stream", cm.with_ctes(cm.INTERACTIONS_SQL, MASTERY_SQL, PROFILE_SQL) + """
select student_id, total_questions, correct_answers, round(average_response_quality, 6) as average_response_quality from prof""")
def profile_stream(spark, sf_dir):
    rows = cm.interactions_of(landed(spark, sf_dir, "events"))
    return jobs.profile_stream(rows).select(
        "student_id", "total_questions", "correct_answers", cm.r6("average_response_quality")
    )


@query("ingest_stream", f"""with n as (select doc_id, len({WORDS.format(x='t')}) as n from (select doc_id, {normalize_sql('text')} as t from documents))
select doc_id as source_id, n as word_count from n where n >= 40""")
def ingest_stream(spark, sf_dir):
    base = scratch_path(spark, "landing")
    jobs.ingest_stream(landed(spark, sf_dir, "documents"), base, "doc_id", content="text", min_words=40, as_of="2024-02-01")
    return ig.read_ingested(spark, base).sources.select("source_id", F.col("word_count").cast("long").alias("word_count"))
