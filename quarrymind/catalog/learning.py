"""Feedback, learner, session and reuse queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrymind.catalog.common import (
    AS_OF, EDGES_SQL, EXPLICIT_SQL, INTERACTIONS_SQL, SIGNALS_SQL, TURNS_SQL,
    edges, explicit_feedback, interactions, r6, signals, table, turns, with_ctes,
)
from quarrymind.operators import feedback as fb
from quarrymind.operators import graph, learners, reuse, sessions

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def joined(col, sep: str = "|"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


# ---------------------------------------------------------------- feedback

# Some rows carry an unknown type, which reads as a rating.
RAW_SQL = """raw as (select * replace (case when signal_id % 97 = 0 then 'wave' else signal_type end as signal_type) from signals)"""


def _raw(spark, sf_dir) -> DataFrame:
    return signals(spark, sf_dir).withColumn(
        "signal_type", F.when(F.col("signal_id") % 97 == 0, "wave").otherwise(F.col("signal_type"))
    )


PARSED_SQL = """typed as (
  select * replace (case when signal_type in ('thumbs_up','thumbs_down','rating','comment','report','dwell_time','scroll_depth',
    'click','copy','followup','rephrase','abandon') then signal_type else 'rating' end as signal_type) from raw),
valued as (
  select *, case signal_type when 'thumbs_up' then 1.0 when 'thumbs_down' then 0.0 when 'report' then 0.0 when 'followup' then 0.6
      when 'rephrase' then 0.3 when 'abandon' then 0.1
      else case when raw_value is null then 0.5 else case signal_type
        when 'rating' then greatest(0.0, least(1.0, (raw_value - 1) / 4))
        when 'dwell_time' then case when raw_value < 5 then 0.2 when raw_value < 15 then 0.4 when raw_value < 30 then 0.6 when raw_value < 60 then 0.8 else 1.0 end
        when 'scroll_depth' then greatest(0.0, least(1.0, raw_value / 100))
        when 'click' then case when raw_value <> 0 then 0.7 else 0.3 end
        when 'copy' then case when raw_value <> 0 then 0.8 else 0.2 end else 0.5 end end end::double as value,
    case when signal_type in ('thumbs_up','thumbs_down','rating','comment','report') then 'explicit'
         when signal_type in ('dwell_time','scroll_depth','click','copy') then 'implicit' else 'behavioral' end as category,
    case signal_type when 'thumbs_up' then 0.95 when 'thumbs_down' then 0.95 when 'rating' then 0.9 when 'comment' then 0.8
      when 'report' then 0.99 when 'dwell_time' then 0.6 when 'scroll_depth' then 0.5 when 'click' then 0.5 when 'copy' then 0.7
      when 'followup' then 0.6 when 'rephrase' then 0.7 else 0.8 end::double as confidence,
    case signal_type when 'thumbs_up' then 1.0 when 'thumbs_down' then 1.0 when 'rating' then 0.9 when 'comment' then 0.7
      when 'report' then 1.2 when 'dwell_time' then 0.4 when 'scroll_depth' then 0.3 when 'click' then 0.3 when 'copy' then 0.5
      when 'followup' then 0.4 when 'rephrase' then 0.6 else 0.7 end::double as type_weight
  from typed),
parsed as (select *, type_weight * confidence as w,
  case when value >= 0.7 then 'positive' when value <= 0.3 then 'negative' else 'neutral' end as polarity from valued)"""


def _weighted_sql(key: str, src: str = "parsed") -> str:
    return f"""
  select {key}, coalesce(sum(value * w) / nullif(sum(w), 0), 0.5) as overall_score,
         sum(value * w) filter (signal_type in ('dwell_time','scroll_depth','click','copy'))
           / sum(w) filter (signal_type in ('dwell_time','scroll_depth','click','copy')) as rel,
         sum(value * w) filter (category = 'explicit') / sum(w) filter (category = 'explicit') as help,
         1 - sum(value * w) filter (signal_type in ('report','rephrase')) / sum(w) filter (signal_type in ('report','rephrase')) as acc,
         count(*) as signal_count, avg(confidence) * (0.7 + 0.3 * least(1.0, count(*) / 5)) as confidence,
         case when count(*) filter (polarity = 'positive') > 2 * count(*) filter (polarity = 'negative') then 'positive'
              when count(*) filter (polarity = 'negative') > 2 * count(*) filter (polarity = 'positive') then 'negative'
              else 'neutral' end as polarity, max(ts) as ts
  from {src} group by {key}"""


BASE = (SIGNALS_SQL, RAW_SQL, PARSED_SQL)
FEEDBACK_SQL = f"feedback as ({_weighted_sql('query_id')})"


def parsed(spark, sf_dir) -> DataFrame:
    return fb.parse_signals(_raw(spark, sf_dir))


@query("signal_parse", with_ctes(*BASE) + """
select signal_id, signal_type, category, round(value, 6) as value, polarity, confidence from parsed""")
def signal_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("signal_id", "signal_type", "category", r6("value"), "polarity", "confidence")


@query("signal_filters", with_ctes(*BASE) + """
select signal_id, 'chunk' as kind from parsed where list_contains(chunk_ids, 21) and confidence >= 0.6
union all select signal_id, 'concept' from parsed where list_contains(concept_ids, 7) and confidence >= 0.6""")
def signal_filters(spark, sf_dir):
    sure = fb.filter_confidence(parsed(spark, sf_dir), 0.6)
    return fb.signals_of_chunk(sure, 21).select("signal_id", F.lit("chunk").alias("kind")).unionByName(
        fb.signals_of_concept(sure, 7).select("signal_id", F.lit("concept").alias("kind"))
    )


@query("feedback_weighted", with_ctes(*BASE, FEEDBACK_SQL) + """
select query_id, round(overall_score, 6) as overall_score, round(coalesce(rel, overall_score), 6) as relevance_score,
       round(coalesce(help, overall_score), 6) as helpfulness_score, round(coalesce(acc, overall_score), 6) as accuracy_score,
       signal_count, round(confidence, 6) as confidence, polarity from feedback""")
def feedback_weighted(spark, sf_dir):
    return fb.weight_feedback(parsed(spark, sf_dir)).select(
        "query_id", r6("overall_score"), r6("relevance_score"), r6("helpfulness_score"), r6("accuracy_score"),
        "signal_count", r6("confidence"), "polarity",
    )


@query("feedback_pattern", with_ctes(*BASE) + """,
recent as (select student_id, value, row_number() over (partition by student_id order by ts desc, signal_id desc) as r
           from parsed qualify r <= 10),
st as (select student_id, count(*) as n, max(value) filter (r = 1) as a, max(value) filter (r = 2) as b, max(value) filter (r = 3) as c,
              var_pop(value) as v, avg(value) as m from recent group by 1),
pt as (select *, case when n >= 3 and a < b and b < c then 'declining' when n >= 3 and a > b and b > c then 'improving'
                      when n >= 5 and v > 0.2 then 'inconsistent' else 'stable' end as pattern from st)
select student_id, pattern, case pattern when 'declining' then 0.7 when 'improving' then 0.7 when 'inconsistent' then 0.6 else 0.5 end::double as confidence,
       case pattern when 'declining' then 'review_content' when 'improving' then 'continue_approach' when 'inconsistent' then 'investigate_chunks' end as suggestion,
       case when pattern = 'stable' then round(m, 6) end as average_score from pt""")
def feedback_pattern(spark, sf_dir):
    return fb.feedback_pattern(parsed(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


# A query's feedback concerns the chunks its signals name.
CHUNK_ROWS_SQL = """chunk_rows as (
  select distinct s.query_id, c.chunk_id, f.ts, f.overall_score
  from (select query_id, unnest(chunk_ids) as chunk_id from signals) c join feedback f using (query_id) join (select distinct query_id from signals) s using (query_id))"""

METRICS_SQL = """cm as (
  select chunk_id, count(*) as total_feedback, count(*) filter (overall_score >= 0.6) as positive_feedback,
         count(*) filter (overall_score < 0.6) as negative_feedback,
         sum(0.3 * pow(0.7, age) * overall_score) + pow(0.7, count(*)) * 0.5 as average_score, max(ts) as last_used
  from (select *, row_number() over (partition by chunk_id order by ts desc, query_id desc) - 1 as age from chunk_rows) group by 1),
chunk_metrics as (select *, case when average_score >= 0.85 then 'excellent' when average_score >= 0.7 then 'good'
  when average_score >= 0.5 then 'fair' when average_score >= 0.3 then 'poor' else 'critical' end as quality,
  average_score < 0.4 as needs_review from cm)"""


def _feedback_with_chunks(spark, sf_dir) -> DataFrame:
    p = parsed(spark, sf_dir)
    named = p.select("query_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    scored = fb.weight_feedback(p)
    return named.join(scored, "query_id").withColumn("chunk_ids", F.array("chunk_id"))


def _chunk_metrics(spark, sf_dir) -> DataFrame:
    return fb.chunk_metrics(_feedback_with_chunks(spark, sf_dir))


CHUNK_CTES = (*BASE, FEEDBACK_SQL, CHUNK_ROWS_SQL, METRICS_SQL)


@query("chunk_ewma", with_ctes(*CHUNK_CTES) + """
select chunk_id, total_feedback, positive_feedback, negative_feedback, round(average_score, 6) as average_score, quality, needs_review from chunk_metrics""")
def chunk_ewma(spark, sf_dir):
    return _chunk_metrics(spark, sf_dir).select(
        "chunk_id", "total_feedback", "positive_feedback", "negative_feedback", r6("average_score"), "quality", "needs_review"
    )


@query("quality_distribution", with_ctes(*CHUNK_CTES) + "select quality, count(*) as chunks from chunk_metrics group by 1")
def quality_distribution(spark, sf_dir):
    return fb.quality_distribution(_chunk_metrics(spark, sf_dir))


USAGE_SQL = """usage as (select l_partkey % (select count(distinct l_suppkey) * 2 from lineitem) as chunk_id, l_returnflag = 'R' as used, l_shipdate as ts from lineitem)"""


def _usage(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    n = line.agg(F.countDistinct("l_suppkey") * 2).scalar()
    return line.select((F.col("l_partkey") % n).alias("chunk_id"), (F.col("l_returnflag") == "R").alias("used_in_answer"), F.col("l_shipdate").alias("ts"))


@query("retrieval_usage", with_ctes(USAGE_SQL) + """
select chunk_id, count(*) as times_retrieved, count(*) filter (used) as times_used_in_answer, strftime(max(ts), '%Y-%m-%d') as last_used from usage group by 1""")
def retrieval_usage(spark, sf_dir):
    return fb.retrieval_usage(_usage(spark, sf_dir)).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd"))


# Stored metrics from an earlier run: suppliers stand in for chunks seen before.
STORED_SQL = """stored as (select s_suppkey + 150 as chunk_id, (s_suppkey % 9)::bigint as total_feedback, 1::bigint as positive_feedback,
  (s_suppkey % 9)::bigint as negative_feedback, ((s_suppkey * 13) % 100) / 100.0::double as average_score from supplier)"""


@query("poor_chunks", with_ctes(*CHUNK_CTES, STORED_SQL) + """,
poor as (select chunk_id, total_feedback, positive_feedback, negative_feedback, average_score from chunk_metrics
  where total_feedback >= 3 and (average_score < 0.45 or positive_feedback / total_feedback < 0.3)),
known as (select * from stored where average_score < 0.45 and total_feedback >= 3),
both_sets as (select * from poor union all select * from known where chunk_id not in (select chunk_id from poor))
select chunk_id, total_feedback, positive_feedback, negative_feedback, round(average_score, 6) as average_score,
  case when average_score >= 0.85 then 'excellent' when average_score >= 0.7 then 'good'
  when average_score >= 0.5 then 'fair' when average_score >= 0.3 then 'poor' else 'critical' end as quality, true as needs_review from both_sets""")
def poor_chunks(spark, sf_dir):
    k = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").select(
        (k + 150).alias("chunk_id"), (k % 9).alias("total_feedback"), F.lit(1).cast("long").alias("positive_feedback"),
        (k % 9).alias("negative_feedback"), (k * 13 % 100 / 100).alias("average_score"),
    )
    return fb.poor_chunks(_chunk_metrics(spark, sf_dir), stored, 0.45).withColumn("average_score", F.round("average_score", 6))


CONCEPTS_SQL = """marks as (
  select unnest(concept_ids) as concept_id, query_id, student_id, ts, value, w,
         case signal_type when 'rephrase' then 2 when 'followup' then 1 when 'thumbs_down' then 2 when 'report' then 3
              else case when value < 0.4 then 1 else 0 end end as mark from parsed),
batches as (select concept_id, query_id, least(1.0, sum(mark) / (count(*) * 2)) as confusion,
                   sum(value * w) / sum(w) as satisfaction, max(ts) as ts from marks group by 1, 2),
students as (select concept_id, count(distinct student_id) as unique_students from marks group by 1),
concept_metrics as (
  select concept_id, count(*) as total_queries, sum(0.2 * pow(0.8, age) * confusion) as confusion_score,
         sum(0.2 * pow(0.8, age) * satisfaction) + pow(0.8, count(*)) * 0.5 as average_satisfaction
  from (select *, row_number() over (partition by concept_id order by ts desc, query_id desc) - 1 as age from batches) group by 1)"""


@query("confusion", with_ctes(*BASE, CONCEPTS_SQL) + """
select concept_id, total_queries, unique_students, round(average_satisfaction, 6) as average_satisfaction,
       round(confusion_score, 6) as confusion_score, confusion_score > 0.5 as is_confusing,
       confusion_score > 0.3 or average_satisfaction < 0.5 as needs_improvement from concept_metrics join students using (concept_id)""")
def confusion(spark, sf_dir):
    return fb.concept_metrics(parsed(spark, sf_dir)).withColumns({
        "average_satisfaction": F.round("average_satisfaction", 6), "confusion_score": F.round("confusion_score", 6)
    })


@query("confusing_concepts", with_ctes(*BASE, CONCEPTS_SQL) + """,
stored as (select 40 + n_nationkey as concept_id, (n_nationkey * 7 % 25) / 25.0 as confusion_score from nation),
a as (select concept_id, confusion_score from concept_metrics where confusion_score >= 0.5),
b as (select * from stored where confusion_score >= 0.5)
select concept_id, round(confusion_score, 6) as confusion_score from (
  select * from a union all select * from b where concept_id not in (select concept_id from a))
order by confusion_score desc, concept_id limit 20""")
def confusing_concepts(spark, sf_dir):
    n = F.col("n_nationkey")
    stored = table(spark, sf_dir, "nation").select(
        (n + 40).cast("long").alias("concept_id"), (n * 7 % 25 / 25).alias("confusion_score"), F.lit(False).alias("is_confusing")
    )
    found = fb.concept_metrics(parsed(spark, sf_dir)).select("concept_id", "confusion_score", "is_confusing")
    return fb.confusing_concepts(found, stored).select("concept_id", r6("confusion_score"))


@query("system_metrics", with_ctes(*CHUNK_CTES, CONCEPTS_SQL) + """
select (select count(*) from chunk_metrics) as total_chunks, round((select avg(average_score) from chunk_metrics), 6) as average_relevance,
       (select count(*) from chunk_metrics where needs_review) as poor_chunks, count(*) as total_concepts,
       round(avg(average_satisfaction), 6) as average_satisfaction, count(*) filter (confusion_score > 0.5) as confusing_concepts,
       greatest(sum(total_queries), (select count(*) from events where ts >= timestamp '2024-01-23'))::bigint as total_queries,
       (select count(*) from feedback where ts >= timestamp '2024-01-23') as total_feedback from concept_metrics""")
def system_metrics(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return fb.system_metrics(
        _chunk_metrics(spark, sf_dir), fb.concept_metrics(p), fb.weight_feedback(p), table(spark, sf_dir, "events"), "2024-01-30"
    ).withColumns({"average_relevance": F.round("average_relevance", 6), "average_satisfaction": F.round("average_satisfaction", 6)})


@query("trending", with_ctes(*BASE) + """,
m as (select unnest(concept_ids) as concept_id, query_id, value, w from parsed where ts >= timestamp '2024-01-23'),
b as (select concept_id, query_id, sum(value * w) / sum(w) as s from m group by 1, 2)
select concept_id, count(*) as total_queries, round(avg(s), 6) as satisfaction from b group by 1
order by total_queries desc, concept_id limit 10""")
def trending(spark, sf_dir):
    return fb.trending(parsed(spark, sf_dir), "2024-01-30").withColumn("satisfaction", F.round("satisfaction", 6))


ENGAGE_SQL = f"""sat as ({_weighted_sql('query_id')}),
eng as (
  select query_id, arg_max(student_id, (ts, signal_id)) as student_id, max(ts) as ts,
         coalesce(arg_max(raw_value, (ts, signal_id)) filter (signal_type = 'dwell_time'), 0) as dwell,
         coalesce(arg_max(raw_value, (ts, signal_id)) filter (signal_type = 'scroll_depth'), 0) as scroll,
         count(*) filter (signal_type = 'click') as clicks, count(*) filter (signal_type = 'copy') as copies,
         count(*) filter (signal_type = 'followup') as followups from parsed group by 1),
engaged as (
  select eng.*, overall_score as satisfaction,
         (least(1.0, dwell / 60) + scroll / 100 + least(1.0, clicks / 3) + least(1, copies)) / 4 as score from eng join sat using (query_id))"""


@query("engagement", with_ctes(*BASE, ENGAGE_SQL) + """
select query_id, student_id, dwell as dwell_time_seconds, scroll as scroll_depth_percent, clicks, copies, followups as followup_questions,
       round(score, 6) as engagement_score, round(satisfaction, 6) as satisfaction_score from engaged""")
def engagement(spark, sf_dir):
    return fb.engagement(parsed(spark, sf_dir)).drop("ts").withColumns({
        "engagement_score": F.round("engagement_score", 6), "satisfaction_score": F.round("satisfaction_score", 6)
    })


@query("student_engagement", with_ctes(*BASE, ENGAGE_SQL) + """
select student_id, count(*) as total_queries, round(avg(dwell), 6) as avg_dwell_time, round(avg(scroll), 6) as avg_scroll_depth,
       sum(clicks)::bigint as total_clicks, sum(copies)::bigint as total_copies, round(avg(score), 6) as avg_engagement_score,
       round(avg(satisfaction), 6) as avg_satisfaction_score from engaged where ts >= timestamp '2024-01-23' group by 1""")
def student_engagement(spark, sf_dir):
    out = fb.student_engagement(fb.engagement(parsed(spark, sf_dir)), "2024-01-30")
    return out.select(
        "student_id", "total_queries", r6("avg_dwell_time"), r6("avg_scroll_depth"), "total_clicks", "total_copies",
        r6("avg_engagement_score"), r6("avg_satisfaction_score"),
    )


@query("student_summary", with_ctes(EXPLICIT_SQL, SIGNALS_SQL) + """,
e as (select * from explicit_feedback where created_at > timestamp '2024-01-15'),
i as (select student_id, count(*) as n from signals where ts > timestamp '2024-01-15' group by 1),
s as (select student_id, count(*) as n, count(*) filter (feedback_type = 'helpful') as h, count(*) filter (feedback_type = 'not_helpful') as nh,
             count(*) filter (feedback_type = 'too_complex') as c, count(*) filter (feedback_type = 'too_simple') as t from e group by 1),
r as (select student_id, string_agg(feedback_type || ':' || rating, '|' order by o) as recent from (
  select *, row_number() over (partition by student_id order by created_at desc, feedback_id desc) as o from e qualify o <= 5) group by 1)
select coalesce(s.student_id, i.student_id) as student_id, coalesce(s.n, 0) + coalesce(i.n, 0) as total_interactions,
       round(case when h + nh > 0 then h / (h + nh) else 0.5 end, 6) as helpful_ratio,
       case when c > t then 'simpler' when t > c then 'advanced' else 'intermediate' end as preferred_complexity, coalesce(recent, '') as recent
from s full join i on s.student_id = i.student_id left join r on r.student_id = coalesce(s.student_id, i.student_id)""")
def student_summary(spark, sf_dir):
    out = fb.student_summary(explicit_feedback(spark, sf_dir), signals(spark, sf_dir), "2024-02-14")
    return out.select(
        "student_id", "total_interactions", r6("helpful_ratio"), "preferred_complexity",
        F.array_join(F.transform("recent_feedback", lambda r: F.concat(r["type"], F.lit(":"), r["rating"].cast("string"))), "|").alias("recent"),
    )


@query("content_summary", with_ctes(EXPLICIT_SQL) + """,
s as (select query_id % 13 as content_id, count(*) as n, count(*) filter (feedback_type = 'helpful') as h,
  count(*) filter (feedback_type in ('not_helpful', 'incorrect', 'incomplete')) as g,
  count(*) filter (feedback_type = 'too_complex') as c, count(*) filter (feedback_type = 'too_simple') as t from explicit_feedback
  group by 1)
select content_id, n as total_feedback, round(h / n, 6) as positive_ratio, round(g / n, 6) as negative_ratio,
       c as too_complex, t as too_simple, h as appropriate,
       concat_ws('|', case when c > n * 0.3 then 'Contenido demasiado complejo para muchos usuarios' end,
         case when t > n * 0.3 then 'Contenido demasiado simple para muchos usuarios' end,
         case when g / n > 0.5 then 'Alto ratio de feedback negativo' end) as common_issues,
       concat_ws('|', case when c > t then 'Simplificar explicaciones|Agregar más ejemplos' end,
         case when t > c then 'Agregar contenido más avanzado' end) as suggested_improvements from s""")
def content_summary(spark, sf_dir):
    rated = explicit_feedback(spark, sf_dir).withColumn("query_id", F.col("query_id") % 13)
    out = fb.content_summary(rated)
    return out.withColumns({
        "positive_ratio": F.round("positive_ratio", 6), "negative_ratio": F.round("negative_ratio", 6),
        "common_issues": F.array_join("common_issues", "|"), "suggested_improvements": F.array_join("suggested_improvements", "|"),
    })


@query("content_engagement", with_ctes(EXPLICIT_SQL, SIGNALS_SQL) + """,
i as (select query_id as content_id, avg(coalesce(raw_value, 0)) filter (signal_type = 'dwell_time') as d,
        avg(coalesce(raw_value, 0)) filter (signal_type = 'scroll_depth') as sc, count(*) filter (signal_type = 'click') as cl,
        count(distinct student_id) as v from signals group by 1),
e as (select query_id as content_id, count(*) filter (feedback_type = 'helpful') as h, count(*) filter (feedback_type <> 'helpful') as nh
      from explicit_feedback group by 1),
j as (select coalesce(i.content_id, e.content_id) as content_id, coalesce(v, 0) as v, coalesce(h, 0) as h, coalesce(nh, 0) as nh,
        coalesce(d, 0) as d, coalesce(sc, 0) as sc, coalesce(cl / nullif(v, 0), 0) as ctr from i full join e on i.content_id = e.content_id)
select content_id, v as total_views, h as helpful_count, nh as not_helpful_count, round(d, 6) as avg_dwell_time_seconds,
       round(sc, 6) as avg_scroll_depth, round(ctr, 6) as click_through_rate,
       round(coalesce(h / nullif(h + nh, 0), 0.5) * 0.3 + least(1.0, d / 60) * 0.3 + sc * 0.2 + ctr * 0.2, 6) as engagement_score from j""")
def content_engagement(spark, sf_dir):
    out = fb.content_engagement(explicit_feedback(spark, sf_dir), signals(spark, sf_dir))
    names = ["avg_dwell_time_seconds", "avg_scroll_depth", "click_through_rate", "engagement_score"]
    return out.withColumns({n: F.round(n, 6) for n in names})


@query("explicit_signals", with_ctes(EXPLICIT_SQL) + """
select feedback_id as signal_id, case when feedback_type = 'helpful' then 'thumbs_up' else 'thumbs_down' end as signal_type,
       query_id, student_id, case when feedback_type = 'helpful' then 1.0 else 0.0 end::double as value,
       case when feedback_type = 'helpful' then 'positive' else 'negative' end as polarity, 0.95::double as confidence from explicit_feedback""")
def explicit_signals(spark, sf_dir):
    return fb.explicit_to_signals(explicit_feedback(spark, sf_dir)).select(
        "signal_id", "signal_type", "query_id", "student_id", "value", "polarity", "confidence"
    )


@query("recent_feedback", with_ctes(EXPLICIT_SQL) + """
select feedback_id, query_id, student_id, feedback_type, rating from explicit_feedback where feedback_type = 'too_complex'
order by created_at desc, feedback_id desc limit 50""")
def recent_feedback(spark, sf_dir):
    return fb.recent_feedback(explicit_feedback(spark, sf_dir), "too_complex").drop("created_at")


# ---------------------------------------------------------------- feedback on the graph

# Every event is one scored feedback on a part, its family and its document.
SCORED_SQL = """sf as (select event_id as feedback_id, ts, ((event_id * 37) % 101) / 100.0::double as overall_score,
   (0.5 + (event_id % 5) / 10.0)::double as confidence, event_id % (select count(*) from part) as p from events),
steps as (
  select feedback_id, ts, case when overall_score >= 0.6 then 'reinforce' when overall_score <= 0.4 then 'weaken' else 'none' end as action,
         case when overall_score >= 0.6 then 0.05 * overall_score * confidence else -0.08 * (1 - overall_score) * confidence end as delta,
         p, p // 2 as fam, p % (select count(*) from documents) as doc from sf)"""


def scored_feedback(spark, sf_dir) -> DataFrame:
    return scored_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "part").agg(F.count("*")).scalar(),
                     table(spark, sf_dir, "documents").agg(F.count("*")).scalar())


def scored_of(events: DataFrame, n_parts, n_docs) -> DataFrame:
    p = F.col("event_id") % n_parts
    return events.select(
        F.col("event_id").alias("feedback_id"), "ts", ((F.col("event_id") * 37) % 101 / 100).alias("overall_score"),
        (0.5 + F.col("event_id") % 5 / 10).alias("confidence"),
        F.array(p % n_docs).alias("chunk_ids"), F.array(p, F.floor(p / 2)).alias("concept_ids"),
    )


# Only concept pairs are raised, so one sum capped at 1 equals the step-by-step rule.
@query("reinforce_edges", with_ctes(EDGES_SQL, SCORED_SQL) + """,
d as (select least(p, fam) as a, greatest(p, fam) as b, sum(delta) as delta from steps where action = 'reinforce' and p <> fam group by 1, 2),
x as (select p as src, doc as dst, sum(delta) as delta from (
  select p, doc, delta from steps where action = 'reinforce' union all select fam, doc, delta from steps where action = 'reinforce') group by 1, 2)
select e.edge_type, e.src, e.dst, round(case
  when edge_type = 'evidenced_by' then case when x.delta is null then weight else least(1.0, weight + x.delta) end
  else case when d.delta is null then weight else least(1.0, weight + d.delta) end end, 6) as weight, negative_signals
from edges e left join d on edge_type <> 'evidenced_by' and d.a = least(e.src, e.dst) and d.b = greatest(e.src, e.dst)
left join x on edge_type = 'evidenced_by' and x.src = e.src and x.dst = e.dst""")
def reinforce_edges(spark, sf_dir):
    return graph.reinforce(scored_feedback(spark, sf_dir), edges(spark, sf_dir)).select(
        "edge_type", "src", "dst", r6("weight"), "negative_signals"
    )


@query("weaken_edges", with_ctes(EDGES_SQL, SCORED_SQL) + """,
x as (select p as src, doc as dst, sum(delta) as delta, count(*) as n from (
  select p, doc, delta from steps where action = 'weaken' union all select fam, doc, delta from steps where action = 'weaken') group by 1, 2)
select e.edge_type, e.src, e.dst, round(case when x.delta is null then weight else greatest(0.1, weight + x.delta) end, 6) as weight,
       negative_signals + coalesce(n, 0) as negative_signals
from edges e left join x on edge_type = 'evidenced_by' and x.src = e.src and x.dst = e.dst""")
def weaken_edges(spark, sf_dir):
    return graph.weaken(scored_feedback(spark, sf_dir), edges(spark, sf_dir)).select(
        "edge_type", "src", "dst", r6("weight"), "negative_signals"
    )


# Raising and lowering mixed: the caps make order matter, so the steps are walked one by one.
MIXED_SQL = """moves as (
  select 'evidence' as link, p as a, doc as b, action, delta, ts, feedback_id, 0 as part from steps where action <> 'none'
  union all select 'evidence', fam, doc, action, delta, ts, feedback_id, 1 from steps where action <> 'none'
  union all select 'concept', least(p, fam), greatest(p, fam), action, delta, ts, feedback_id, 2 from steps where action = 'reinforce'),
keyed as (select *, case when edge_type = 'evidenced_by' then 'evidence' else 'concept' end as link,
   case when edge_type = 'evidenced_by' then src else least(src, dst) end as a,
   case when edge_type = 'evidenced_by' then dst else greatest(src, dst) end as b from edges),
seq as materialized (select link, a, b, action, delta, row_number() over (partition by link, a, b order by ts, feedback_id, part) as i from moves),
walk as (
  select edge_type, src, dst, link, a, b, weight, negative_signals, 0::bigint as i from keyed
  union all
  select edge_type, src, dst, w.link, w.a, w.b, case when action = 'reinforce' then least(1.0, weight + delta) else greatest(0.1, weight + delta) end,
         negative_signals + (action = 'weaken')::int, seq.i
  from walk w join seq on seq.link = w.link and seq.a = w.a and seq.b = w.b and seq.i = w.i + 1)
select edge_type, src, dst, round(arg_max(weight, i), 6) as weight, max(negative_signals) as negative_signals from walk group by 1, 2, 3"""


@query("apply_feedback", "with recursive " + ",\n".join([EDGES_SQL, SCORED_SQL]) + ",\n" + MIXED_SQL)
def apply_feedback(spark, sf_dir):
    return graph.apply_feedback(scored_feedback(spark, sf_dir), edges(spark, sf_dir))["edges"].select(
        "edge_type", "src", "dst", r6("weight"), "negative_signals"
    )


@query("pending_updates", "with recursive " + ",\n".join([EDGES_SQL, SCORED_SQL.replace("from events)", "from events where event_type <> 'click')")]) + ",\n" + MIXED_SQL)
def pending_updates(spark, sf_dir):
    """Updates of click events count as applied already."""
    clicks = table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), (F.col("event_type") == "click").alias("applied"))
    updates = graph.edge_updates(scored_feedback(spark, sf_dir)).join(clicks, "feedback_id")
    return graph.apply_pending(updates, edges(spark, sf_dir)).select("edge_type", "src", "dst", r6("weight"), "negative_signals")


@query("feedback_summary", with_ctes(SCORED_SQL) + """
select feedback_id, action, case when action = 'reinforce' then 3 else 0 end as edges_reinforced,
       case when action = 'weaken' then 2 else 0 end as edges_weakened, overall_score <= 0.25 as revectorization_scheduled
from steps join sf using (feedback_id)""")
def feedback_summary(spark, sf_dir):
    return graph.apply_feedback(scored_feedback(spark, sf_dir), edges(spark, sf_dir))["summary"]


@query("review_marks", with_ctes(SCORED_SQL) + """
select doc as chunk_id, 'low_feedback_score_' || format('{:.2f}', arg_max(overall_score, (ts, feedback_id))) as review_reason
from steps join (select feedback_id, overall_score from sf) using (feedback_id) where overall_score < 0.2 group by 1""")
def review_marks(spark, sf_dir):
    return graph.review_marks(scored_feedback(spark, sf_dir)).select("chunk_id", "review_reason")


@query("finish_tasks", with_ctes(SCORED_SQL) + """
select feedback_id as task_id, case when feedback_id % 4 = 3 then 'pending' when feedback_id % 4 = 0 or feedback_id % 12 = 1 then 'failed' else 'completed' end as status
from sf where overall_score <= 0.25""")
def finish_tasks(spark, sf_dir):
    """Every fourth task has no outcome yet; of two outcomes of a task a failure counts."""
    tasks = graph.revector_tasks(scored_feedback(spark, sf_dir))
    i = F.col("task_id")
    once = tasks.where(i % 4 != 3).select("task_id", (i % 4 != 0).alias("ok"))
    twice = tasks.where(i % 12 == 1).select("task_id", F.lit(False).alias("ok"))
    return graph.finish_tasks(tasks, once.unionByName(twice)).select("task_id", "status")


@query("revector_queue", with_ctes(SCORED_SQL) + """,
picked as (select s.feedback_id as task_id, doc as chunk_id from steps s join (select feedback_id, overall_score from sf) f using (feedback_id)
  where overall_score <= 0.25 order by s.ts, s.feedback_id limit 5)
select task_id, 2 as priority, chunk_id, length(text) as n from picked join documents on doc_id = chunk_id""")
def revector_queue(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    tasks = graph.revector_tasks(scored_feedback(spark, sf_dir))
    return graph.revector_queue(tasks, chunks).select("task_id", "priority", "chunk_id", F.length("content").alias("n"))


@query("pending_summary", with_ctes(SCORED_SQL) + """
select (select count(*) * 3 from steps join events on event_id = feedback_id where action = 'reinforce' and event_type <> 'click')
     + (select count(*) * 2 from steps join events on event_id = feedback_id where action = 'weaken' and event_type <> 'click') as pending_edge_updates,
       (select count(*) from sf where overall_score <= 0.25) as pending_revectorizations,
       (select count(*) * 3 from steps join events on event_id = feedback_id where action = 'reinforce' and event_type <> 'click')
     + (select count(*) * 2 from steps join events on event_id = feedback_id where action = 'weaken' and event_type <> 'click')
     + (select count(*) from sf where overall_score <= 0.25) as total_pending""")
def pending_summary(spark, sf_dir):
    scored = scored_feedback(spark, sf_dir)
    clicks = table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), (F.col("event_type") == "click").alias("applied"))
    return graph.pending_summary(graph.edge_updates(scored).join(clicks, "feedback_id"), graph.revector_tasks(scored))


# ---------------------------------------------------------------- learners

MASTERY_SQL = """mast as (
  select student_id, concept_id, n as interactions, last_reviewed,
         sum(0.2 * pow(0.8, age) * score) + pow(0.8, n) * any_value(first) as mastery_score
  from (select *, row_number() over (partition by student_id, concept_id order by ts desc, interaction_id desc) - 1 as age,
               count(*) over (partition by student_id, concept_id) as n,
               first_value(score) over (partition by student_id, concept_id order by ts, interaction_id) as first,
               max(ts) over (partition by student_id, concept_id) as last_reviewed from interactions) group by 1, 2, 3, 4),
student_concept as (select *, case when interactions = 1 then mastery_score < 0.4 else mastery_score < 0.4 and interactions >= 3 end as is_weakness from mast)"""

PROFILE_SQL = """prof as (
  select student_id, count(*) as total_questions, count(*) filter (score >= 0.7) as correct_answers,
         sum(0.1 * pow(0.9, age) * score) as average_response_quality
  from (select *, row_number() over (partition by student_id order by ts desc, interaction_id desc) - 1 as age from interactions) group by 1),
profiles as (select p.*, correct_answers / total_questions as accuracy_rate, m.avg_mastery, m.n_concepts
  from prof p join (select student_id, avg(mastery_score) as avg_mastery, count(*) as n_concepts from student_concept group by 1) m using (student_id))"""


@query("mastery", with_ctes(INTERACTIONS_SQL, MASTERY_SQL) + """
select student_id, concept_id, round(mastery_score, 6) as mastery_score, interactions, is_weakness from student_concept""")
def mastery(spark, sf_dir):
    return learners.mastery(interactions(spark, sf_dir)).select(
        "student_id", "concept_id", r6("mastery_score"), "interactions", "is_weakness"
    )


@query("profile_updates", with_ctes(INTERACTIONS_SQL, MASTERY_SQL, PROFILE_SQL, """old as (
  select c_custkey as student_id, 10 as q, 4 as c, 0.5 as a from customer where c_custkey % 3 = 0)""") + """
select coalesce(p.student_id, o.student_id) as student_id, coalesce(total_questions, 0) + coalesce(q, 0) as total_questions,
       coalesce(correct_answers, 0) + coalesce(c, 0) as correct_answers,
       round(coalesce(average_response_quality, 0) + pow(0.9, coalesce(total_questions, 0)) * coalesce(a, 0), 6) as average_response_quality
from prof p full join old o on p.student_id = o.student_id""")
def profile_updates(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("student_id"), F.lit(10).alias("total_questions"), F.lit(4).alias("correct_answers"),
        F.lit(0.5).alias("average_response_quality"),
    )
    return learners.update_profiles(interactions(spark, sf_dir), stored).select(
        "student_id", "total_questions", "correct_answers", r6("average_response_quality")
    )


def _profiles(spark, sf_dir):
    i = interactions(spark, sf_dir)
    return learners.profiles(learners.update_profiles(i), learners.mastery(i))


_LEVEL = """case when s >= 0.9 then 'expert' when s >= 0.75 then 'advanced' when s >= 0.5 then 'intermediate'
  when s >= 0.25 then 'elementary' else 'beginner' end"""


@query("levels", with_ctes(INTERACTIONS_SQL, MASTERY_SQL, PROFILE_SQL) + f"""
select student_id, round(accuracy_rate, 6) as accuracy_rate, round(avg_mastery, 6) as avg_mastery, n_concepts, {_LEVEL} as level,
       case {_LEVEL} when 'beginner' then 'detailed' when 'elementary' then 'moderate' when 'intermediate' then 'standard'
         when 'advanced' then 'concise' else 'brief' end as explanation_depth,
       case {_LEVEL} when 'beginner' then 0.3 when 'elementary' then 0.5 when 'intermediate' then 0.7 when 'advanced' then 0.9 else 1.0 end::double as max_complexity
from (select *, accuracy_rate * 0.4 + avg_mastery * 0.6 as s from profiles)""")
def levels(spark, sf_dir):
    out = learners.with_level_config(learners.levels(_profiles(spark, sf_dir)))
    return out.select(
        "student_id", r6("accuracy_rate"), r6("avg_mastery"), F.size("concept_mastery").cast("long").alias("n_concepts"),
        "level", "explanation_depth", "max_complexity",
    )


WEAK_SQL = """known as (
  select student_id, concept_id from (
    select *, date_diff('second', last_reviewed, timestamp '2024-02-10') // 86400 as days from student_concept)
  where is_weakness or (mastery_score < 0.4 and interactions >= 2) or (days > 7 and mastery_score < 0.7) or (days > 30 and mastery_score < 0.85)
  union
  select student_id, concept_id from interactions where confused or score < 0.5 group by 1, 2 having count(*) >= 2),
prereq as (select p_partkey // 2 as needed, p_partkey as concept_id from part where p_partkey > 0),
gaps as (
  select distinct s.student_id, p.needed from student_concept s left join known k using (student_id, concept_id)
  join prereq p on p.concept_id = s.concept_id left join student_concept h on h.student_id = s.student_id and h.concept_id = p.needed
  where (s.mastery_score < 0.5 or k.student_id is not null) and (h.mastery_score is null or h.mastery_score < 0.6)),
weak as (select * from known union select * from gaps)"""


def _weak(spark, sf_dir):
    i = interactions(spark, sf_dir)
    held = learners.mastery(i)
    return learners.weaknesses(held, i, edges(spark, sf_dir), AS_OF), held


@query("weaknesses", with_ctes(INTERACTIONS_SQL, MASTERY_SQL, WEAK_SQL) + "select student_id, concept_id from weak")
def weaknesses(spark, sf_dir):
    return _weak(spark, sf_dir)[0]


@query("recommend", with_ctes(INTERACTIONS_SQL, MASTERY_SQL, WEAK_SQL) + """,
c as (select student_id, concept_id, min((p, m)) as o from (
  select student_id, concept_id, 0 as p, 0.0 as m from weak union all select student_id, concept_id, 1, mastery_score from student_concept) group by 1, 2)
select student_id, concept_id, row_number() over (partition by student_id order by o, concept_id) as rank from c qualify rank <= 5""")
def recommend(spark, sf_dir):
    return learners.recommend(*_weak(spark, sf_dir))


@query("new_profiles", """
select distinct user_id as student_id, 'beginner' as level, 'reading' as learning_style, 0 as total_questions, 0.0::double as average_response_quality
from events where user_id not in (select c_custkey from customer where c_custkey % 3 = 0)""")
def new_profiles(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("student_id"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("student_id"))
    return learners.new_profiles(log, known, AS_OF).select(
        "student_id", "level", "learning_style", "total_questions", "average_response_quality"
    )


# ---------------------------------------------------------------- sessions

# Every ninth turn is a system turn, so that the role filter matters.
TALK_SQL = "talk as (select * replace (case when (session_id + turn_no) % 9 = 8 then 'system' else role end as role) from turns)"


def talk(spark, sf_dir):
    system = (F.col("session_id") + F.col("turn_no")) % 9 == 8
    return turns(spark, sf_dir).withColumn("role", F.when(system, "system").otherwise(F.col("role")))


@query("recent_context", with_ctes(TURNS_SQL, TALK_SQL) + """
select session_id, turn_no, role, token_count from (
  select *, row_number() over w as age, sum(token_count) over w as used from talk where role <> 'system'
  window w as (partition by session_id order by turn_no desc)) where age <= 4 and used <= 300""")
def recent_context(spark, sf_dir):
    return sessions.recent_context(talk(spark, sf_dir), 4, 300).select("session_id", "turn_no", "role", "token_count")


@query("context_messages", with_ctes(TURNS_SQL, TALK_SQL) + """
select session_id, md5(string_agg(role || ':' || content, '|' order by turn_no)) as messages, count(*) as n from (
  select *, row_number() over w as age, sum(token_count) over w as used from talk where role <> 'system'
  window w as (partition by session_id order by turn_no desc)) where age <= 20 and used <= 400 group by 1""")
def context_messages(spark, sf_dir):
    out = sessions.context_messages(talk(spark, sf_dir), 400)
    return out.select(
        "session_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("messages"),
        F.size("messages").cast("long").alias("n"),
    )


# The insert-by-insert rule, walked turn by turn; `first` is the oldest turn still held.
RETAIN_SQL = """num as materialized (select *, row_number() over (partition by session_id order by turn_no) as i from turns),
walk as (
  select session_id, 1::bigint as i, 1::bigint as first from num where i = 1
  union all
  select w.session_id, n.i, (
    select min(j) from (select unnest(range(greatest(w.first, n.i - 3), n.i + 1)) as j)
    where j >= n.i - 2 or (select sum(token_count) from num t where t.session_id = n.session_id and t.i between j and n.i) <= 300)
  from walk w join num n on n.session_id = w.session_id and n.i = w.i + 1),
fin as (select session_id, arg_max(first, i) as first from walk group by 1)"""


@query("retained_turns", "with recursive " + ",\n".join([TURNS_SQL, RETAIN_SQL]) + """
select session_id, turn_no, token_count from num join fin using (session_id) where i >= first""")
def retained_turns(spark, sf_dir):
    return sessions.retained_turns(turns(spark, sf_dir), 4, 300).select("session_id", "turn_no", "token_count")


ACTIVE_SQL = """num as materialized (select session_id, concepts, row_number() over (partition by session_id order by turn_no) as i from turns),
walk as (
  select session_id, 1::bigint as i, list_distinct(concepts)::bigint[] as held0, concepts[1:1] || case when concepts[2] <> concepts[1] then concepts[2:2] else [] end as held from num where i = 1
  union all
  select w.session_id, n.i, held0, (held || list_filter(n.concepts[1:1], lambda c: not list_contains(held, c))
     || list_filter(n.concepts[2:2], lambda c: c <> n.concepts[1] and not list_contains(held, c)))[-6:]
  from walk w join num n on n.session_id = w.session_id and n.i = w.i + 1),
fin as (select session_id, arg_max(held, i) as held from walk group by 1)"""


@query("active_concepts", "with recursive " + ",\n".join([TURNS_SQL, ACTIVE_SQL]) + """
select session_id, array_to_string(held, '|') as concepts from fin""")
def active_concepts(spark, sf_dir):
    return sessions.active_concepts(turns(spark, sf_dir), 6).select("session_id", joined("concepts").alias("concepts"))


@query("suggestions", "with recursive " + ",\n".join([TURNS_SQL, ACTIVE_SQL.replace("[-6:]", "[-10:]")]) + """
select session_id, array_to_string(held[1:5], '|') as topics from fin""")
def suggestions(spark, sf_dir):
    return sessions.suggestions(turns(spark, sf_dir)).select("session_id", joined("topics").alias("topics"))


@query("related_turns", with_ctes(TURNS_SQL) + """,
s as (select session_id, turn_no, len(list_intersect(list_distinct(concepts), [session_id % 15, 3, 7])) as overlap from turns)
select session_id, turn_no, overlap, row_number() over (partition by session_id order by overlap desc, turn_no) as rank
from s where overlap > 0 qualify rank <= 3""")
def related_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    wanted = t.select("session_id").distinct().withColumn(
        "wanted_concepts", F.array(F.col("session_id") % 15, F.lit(3).cast("long"), F.lit(7).cast("long"))
    )
    return sessions.related_turns(t, wanted, 3).select("session_id", "turn_no", F.col("overlap").cast("long").alias("overlap"), "rank")


@query("session_summary", with_ctes(TURNS_SQL) + """,
num as (select *, row_number() over (partition by session_id order by turn_no) as i, count(*) over (partition by session_id) as n from turns),
old as (select session_id, '[Conversation Summary]' || chr(10) || string_agg(
    case role when 'user' then '- User asked about: ' when 'assistant' then '- Assistant explained: ' end || content[1:100] || '...', chr(10) order by i) as content
  from num where n > 3 and i <= 3 group by 1),
cs as (select session_id, string_agg(c, '|' order by c) as concepts from (
  select distinct session_id, unnest(concepts) as c from num where n > 3 and i <= 3) group by 1)
select session_id, 0 as turn_no, 'system' as role, md5(content) as content, concepts, true as is_summary, length(content) // 4 as token_count
from old join cs using (session_id)
union all select session_id, turn_no, role, md5(content), array_to_string(concepts, '|'), false, token_count from num where n <= 3 or i > 3""")
def session_summary(spark, sf_dir):
    return sessions.summarize_sessions(turns(spark, sf_dir), 3).select(
        "session_id", "turn_no", "role", F.md5("content").alias("content"), joined("concepts").alias("concepts"), "is_summary", "token_count"
    )


@query("session_stats", with_ctes(TURNS_SQL) + """
select session_id, count(*) as total_turns, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns,
       sum(token_count)::bigint as total_tokens, epoch(max(ts) - min(ts))::bigint as seconds from turns group by 1""")
def session_stats(spark, sf_dir):
    return sessions.session_stats(turns(spark, sf_dir)).select(
        "session_id", "total_turns", "user_turns", "assistant_turns", "total_tokens",
        F.timestamp_diff("SECOND", F.col("created_at"), F.col("last_activity")).alias("seconds"),
    )


@query("session_round_trip", "with recursive " + ",\n".join([TURNS_SQL, RETAIN_SQL]) + """
select session_id, count(*) as turns, sum(token_count)::bigint as total_tokens from num join fin using (session_id) where i >= first group by 1""")
def session_round_trip(spark, sf_dir):
    t = turns(spark, sf_dir)
    return sessions.import_sessions(sessions.export_sessions(t, 4, 300), t.schema)[1]


# ---------------------------------------------------------------- reuse

# User turns ask, the next turn answers; each text is asked again after 30 minutes and after 2 hours.
REUSE_SQL = """asked as (select t.session_id * 100 + t.turn_no as query_id, t.session_id % 3 as tenant, t.content as text, t.ts, a.content as answer, a.concepts
   from turns t join turns a on a.session_id = t.session_id and a.turn_no = t.turn_no + 1 where t.role = 'user' and a.role = 'assistant'),
keyed as (select *, sha256('{"database":"' || tenant || '","query":' || to_json(lower(trim(text, ' ')))::varchar || '}')[1:16] as answer_key from asked),
probes as (select query_id * 10 + k as probe_id, answer_key, tenant, ts + interval 1 minute * (case k when 1 then 30 else 120 end) as ts from keyed, (values (1), (2)) v(k)),
latest as (
  select p.probe_id, p.tenant, p.ts, p.answer_key, (select max((k.ts, k.query_id, k.answer)) from keyed k where k.answer_key = p.answer_key and k.ts <= p.ts) as l from probes p)"""


def _asked(spark, sf_dir):
    t = turns(spark, sf_dir)
    answers = t.where("role = 'assistant'").select(
        "session_id", (F.col("turn_no") - 1).alias("turn_no"), F.col("content").alias("answer"), F.col("concepts").alias("a_concepts")
    )
    asked = t.where("role = 'user'").join(answers, ["session_id", "turn_no"]).select(
        (F.col("session_id") * 100 + F.col("turn_no")).alias("query_id"), (F.col("session_id") % 3).alias("tenant"),
        F.col("content").alias("text"), "ts", "answer", F.col("a_concepts").alias("concepts"),
    )
    return reuse.with_answer_key(asked)


def _probes(keyed):
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    return keyed.withColumn("k", k).select(
        (F.col("query_id") * 10 + F.col("k")).alias("probe_id"), "answer_key", "tenant", "text",
        (F.col("ts") + F.when(F.col("k") == 1, F.expr("interval 30 minutes")).otherwise(F.expr("interval 2 hours"))).alias("ts"),
    )


def _reused(spark, sf_dir):
    keyed = _asked(spark, sf_dir)
    answers = keyed.select(F.col("query_id").alias("answer_id"), "answer_key", "answer", F.col("ts").alias("created_at"), F.lit(3600).alias("ttl_seconds"))
    return reuse.reuse_answers(_probes(keyed).drop("text"), answers)


@query("answer_keys", with_ctes(TURNS_SQL, REUSE_SQL) + "select query_id, answer_key from keyed")
def answer_keys(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "answer_key")


@query("answer_reuse", with_ctes(TURNS_SQL, REUSE_SQL) + """
select probe_id, tenant, l is not null and ts <= l[1] + interval 1 hour as from_cache,
       case when l is not null and ts <= l[1] + interval 1 hour then md5(l[3]) end as answer from latest""")
def answer_reuse(spark, sf_dir):
    return _reused(spark, sf_dir).select("probe_id", "tenant", "from_cache", F.md5("answer").alias("answer"))


@query("reuse_stats", with_ctes(TURNS_SQL, REUSE_SQL) + """
select tenant, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, round(count(*) filter (hit) / count(*), 6) as hit_rate
from (select tenant, l is not null and ts <= l[1] + interval 1 hour as hit from latest) group by 1""")
def reuse_stats(spark, sf_dir):
    return reuse.reuse_stats(_reused(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("invalidate", with_ctes(TURNS_SQL, REUSE_SQL) + """
select query_id from keyed where answer_key not in (select answer_key from keyed where query_id % 7 = 0)
  and not list_contains(concepts, 3) and not list_contains(concepts, 5)""")
def invalidate(spark, sf_dir):
    keyed = reuse.answer_tags(_asked(spark, sf_dir))
    return reuse.invalidate(keyed, keys=keyed.where("query_id % 7 = 0"), tags=["concept:3"], concepts=[5]).select("query_id")


@query("embedding_reuse", with_ctes(TURNS_SQL, REUSE_SQL) + """,
e as (select answer_key, max(ts) as ts from keyed where tenant <> 2 group by 1)
select p.probe_id, coalesce(e.ts is not null and date_diff('second', e.ts, p.ts) <= 3600, false) as reused from probes p left join e using (answer_key)""")
def embedding_reuse(spark, sf_dir):
    keyed = _asked(spark, sf_dir)
    stored = keyed.where("tenant <> 2").select(
        F.col("answer_key").alias("emb_key"), F.array(F.lit(1.0)).alias("embedding"), F.col("ts").alias("created_at"), F.lit(3600).alias("ttl_seconds")
    )
    hits, misses = reuse.reuse_embeddings(_probes(keyed), stored)
    return hits.select("probe_id", F.lit(True).alias("reused")).unionByName(misses.select("probe_id", F.lit(False).alias("reused")))
