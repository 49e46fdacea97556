"""Table loading and inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.operators.ranking import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values: list) -> F.Column:
    """Element of a fixed list by a computed 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


SIGNAL_TYPES = [
    "thumbs_up", "thumbs_down", "rating", "comment", "report", "dwell_time",
    "scroll_depth", "click", "copy", "followup", "rephrase", "abandon",
]
FEEDBACK_TYPES = ["helpful", "not_helpful", "too_complex", "too_simple", "incorrect", "incomplete"]
SOURCES = ["vector", "bm25", "graph"]


def sql_list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def r6(c, name: str | None = None):
    """Six decimals, so that both engines' sums compare equal."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c) if (name or isinstance(c, str)) else col


# ---- ranked hits: every event is one hit of a user's query in one source ----

def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"),
        pick(F.col("event_id") % 3, SOURCES).alias("source"),
        (F.floor(F.col("event_id") / 2) * 7 % n_docs).alias("doc_id"),
        F.col("value").alias("score"),
        "event_id",
    )
    return number_rows(rows, ["query_id", "source"], -F.floor("score"), [F.col("score").desc(), F.col("event_id")]).drop("event_id")


HITS_SQL = f"""hits as (
  select query_id, source, doc_id, score,
         row_number() over (partition by query_id, source order by score desc, event_id) as rank
  from (select user_id as query_id, ({sql_list(SOURCES)})[event_id % 3 + 1] as source,
               (event_id // 2) * 7 % (select count(*) from documents) as doc_id, value as score, event_id from events))"""


# ---- feedback signals and explicit feedback ----

def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return signals_of(e)


def signals_of(e: DataFrame) -> DataFrame:
    kind = pick(F.col("event_id") % 12, SIGNAL_TYPES)
    raw = (
        F.when(F.col("signal_type") == "rating", (1 + F.col("event_id") % 5).cast("double"))
        .when(F.col("signal_type").isin("click", "copy"), (F.floor(F.col("event_id") / 12) % 2).cast("double"))
        .when(F.col("signal_type") == "comment", F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return e.withColumn("signal_type", kind).select(
        F.col("event_id").alias("signal_id"), "signal_type", raw.alias("raw_value"),
        F.floor(F.col("event_id") / 8).alias("query_id"),
        F.array(F.col("event_id") % 200, (F.col("event_id") * 7) % 200).alias("chunk_ids"),
        F.array(F.floor(F.col("event_id") / 3) % 50).alias("concept_ids"),
        F.col("user_id").alias("student_id"), "ts",
    )


SIGNALS_SQL = f"""signals as (
  select event_id as signal_id, signal_type,
         case when signal_type = 'rating' then 1.0 + event_id % 5
              when signal_type in ('click', 'copy') then (event_id // 12) % 2
              when signal_type = 'comment' then null else value end::double as raw_value,
         event_id // 8 as query_id, [event_id % 200, (event_id * 7) % 200] as chunk_ids,
         [event_id // 3 % 50] as concept_ids, user_id as student_id, ts
  from (select *, ({sql_list(SIGNAL_TYPES)})[event_id % 12 + 1] as signal_type from events))"""


def explicit_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("feedback_id"), (F.col("event_id") % 40).alias("query_id"),
        F.col("user_id").alias("student_id"), pick(F.col("event_id") % 6, FEEDBACK_TYPES).alias("feedback_type"),
        (1 + F.col("event_id") % 5).cast("int").alias("rating"), F.col("ts").alias("created_at"),
    )


EXPLICIT_SQL = f"""explicit_feedback as (
  select event_id as feedback_id, event_id % 40 as query_id, user_id as student_id,
         ({sql_list(FEEDBACK_TYPES)})[event_id % 6 + 1] as feedback_type, 1 + event_id % 5 as rating, ts as created_at
  from events)"""


# ---- concept graph: parts on neighbouring lines of an order, part families, supporting documents ----

def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"), F.lit("concept").alias("node_type"),
        F.col("p_name").alias("name"), F.col("p_type").alias("description"),
    )


NODES_SQL = """nodes as (
  select p_partkey as node_id, 'concept' as node_type, p_name as name, p_type as description from part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines are matched by (order, line number), so no order is paired with itself."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("q"))
    related = (
        line.join(after, ["l_orderkey", "l_linenumber"]).where(F.col("p") != F.col("q"))
        .groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.count("*").alias("c"))
        .select(
            F.lit("relates_to").alias("edge_type"), "src", "dst",
            F.least(F.lit(1.0), F.round((F.col("c") * 20 + (F.col("src") + F.col("dst")) % 7 * 10) / 100, 2)).alias("weight"),
        )
    )
    part = table(spark, sf_dir, "part")
    family = part.where("p_partkey > 0").select(
        F.lit("prerequisite").alias("edge_type"), F.floor(F.col("p_partkey") / 2).alias("src"),
        F.col("p_partkey").alias("dst"), F.lit(0.9).alias("weight"),
    )
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    evidence = part.select(
        F.lit("evidenced_by").alias("edge_type"), F.col("p_partkey").alias("src"),
        (F.col("p_partkey") % n_docs).alias("dst"), F.lit(0.8).alias("weight"),
    )
    return (
        related.unionByName(family).unionByName(evidence)
        .withColumn("confidence", F.lit(0.8))
        .withColumn("negative_signals", ((F.col("src") + F.col("dst")) % 8).cast("int"))
    )


EDGES_SQL = """line as (select l_orderkey, l_linenumber, min(l_partkey) as p from lineitem group by all),
edges as (
  select *, 0.8::double as confidence, ((src + dst) % 8)::int as negative_signals from (
    select 'relates_to' as edge_type, src, dst,
           least(1.0, round((c * 20 + (src + dst) % 7 * 10) / 100.0, 2))::double as weight
    from (select least(a.p, b.p) as src, greatest(a.p, b.p) as dst, count(*) as c
          from line a join line b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
          where a.p <> b.p group by 1, 2)
    union all select 'prerequisite', p_partkey // 2, p_partkey, 0.9 from part where p_partkey > 0
    union all select 'evidenced_by', p_partkey, p_partkey % (select count(*) from documents), 0.8 from part))"""


# ---- conversation turns ----

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        "role", F.col("text").alias("content"),
        F.array((F.col("conv_id") * 7 + F.col("turn")) % 15, (F.col("conv_id") + F.col("turn") * 3) % 15).alias("concepts"),
        F.array(F.col("conv_id") % 20, F.col("turn")).alias("chunks_used"),
        F.floor(F.length("text") / 4).cast("int").alias("token_count"),
    )


TURNS_SQL = """turns as (
  select conv_id as session_id, turn as turn_no,
         timestamp '2024-01-01' + interval 1 hour * conv_id + interval 1 minute * turn as ts,
         role, text as content, [(conv_id * 7 + turn) % 15, (conv_id + turn * 3) % 15] as concepts,
         [conv_id % 20, turn] as chunks_used, (length(text) // 4)::int as token_count
  from conversations)"""


# ---- learner interactions ----

def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_of(table(spark, sf_dir, "events"))


def interactions_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("interaction_id"), F.col("user_id").alias("student_id"),
        (F.col("event_id") % 50).alias("concept_id"), ((F.col("event_id") * 37) % 101 / 100).alias("score"),
        (F.col("event_type") == "error").alias("confused"), "ts",
    )


INTERACTIONS_SQL = """interactions as (
  select event_id as interaction_id, user_id as student_id, event_id % 50 as concept_id,
         ((event_id * 37) % 101) / 100.0::double as score, event_type = 'error' as confused, ts
  from events)"""

AS_OF = "2024-02-10 00:00:00"

# Java's Unicode word class spelled for RE2.
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
