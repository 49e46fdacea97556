"""Feedback signals: parsing, weighting, patterns, content and concept metrics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.operators.ranking import ewma, ewma_fold, ewma_parts, ewma_totals, top_k

# Fixed values per signal type: category, confidence, weight, and value where it does not
# depend on what was measured.
SIGNALS = {
    "thumbs_up": ("explicit", 0.95, 1.0, 1.0),
    "thumbs_down": ("explicit", 0.95, 1.0, 0.0),
    "rating": ("explicit", 0.9, 0.9, None),
    "comment": ("explicit", 0.8, 0.7, None),
    "report": ("explicit", 0.99, 1.2, 0.0),
    "dwell_time": ("implicit", 0.6, 0.4, None),
    "scroll_depth": ("implicit", 0.5, 0.3, None),
    "click": ("implicit", 0.5, 0.3, None),
    "copy": ("implicit", 0.7, 0.5, None),
    "followup": ("behavioral", 0.6, 0.4, 0.6),
    "rephrase": ("behavioral", 0.7, 0.6, 0.3),
    "abandon": ("behavioral", 0.8, 0.7, 0.1),
}
OTHER_WEIGHT = 0.5

# Explicit feedback types as signals; all but the first are negative.
FEEDBACK_SIGNAL = {
    "helpful": "thumbs_up",
    "not_helpful": "thumbs_down",
    "too_complex": "thumbs_down",
    "too_simple": "thumbs_down",
    "incorrect": "thumbs_down",
    "incomplete": "thumbs_down",
}

CHUNK_ALPHA, CONCEPT_ALPHA = 0.3, 0.2


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)


def signal_value(kind: Column, raw: Column) -> Column:
    """Signal strength in [0, 1]; what is missing or unreadable counts as 0.5."""
    number = raw.cast("string").try_cast("double")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    fixed = _lookup({k: v[3] for k, v in SIGNALS.items() if v[3] is not None}, kind)
    measured = (
        F.when(kind == "rating", unit((number - 1) / 4))
        .when(
            kind == "dwell_time",
            F.when(number < 5, 0.2).when(number < 15, 0.4).when(number < 30, 0.6).when(number < 60, 0.8).when(number >= 60, 1.0),
        )
        .when(kind == "scroll_depth", unit(number / 100))
        .when(kind == "click", F.when(number != 0, 0.7).otherwise(0.3))
        .when(kind == "copy", F.when(number != 0, 0.8).otherwise(0.2))
    )
    return F.coalesce(fixed, F.when(number.isNull(), F.lit(0.5)).otherwise(measured), F.lit(0.5))


def polarity(value: Column) -> Column:
    return F.when(value >= 0.7, "positive").when(value <= 0.3, "negative").otherwise("neutral")


def parse_signals(raw: DataFrame) -> DataFrame:
    """Add category, value, polarity and confidence; an unknown type reads as a rating."""
    kind = F.when(F.col("signal_type").isin(*SIGNALS), F.col("signal_type")).otherwise(F.lit("rating"))
    parsed = raw.withColumn("signal_type", kind)
    kind = F.col("signal_type")
    return (
        parsed.withColumn("category", _lookup({k: v[0] for k, v in SIGNALS.items()}, kind))
        .withColumn("value", signal_value(kind, F.col("raw_value")))
        .withColumn("polarity", polarity(F.col("value")))
        .withColumn("confidence", _lookup({k: v[1] for k, v in SIGNALS.items()}, kind))
    )


def _weight(weights: dict[str, float] | None) -> Column:
    table = weights or {k: v[2] for k, v in SIGNALS.items()}
    return F.coalesce(_lookup(table, F.col("signal_type")), F.lit(OTHER_WEIGHT)) * F.col("confidence")


def _weighted(when: Column) -> Column:
    """Weighted mean of the signals for which ``when`` holds; null when there are none."""
    total = F.sum(F.when(when, F.col("_w")))
    return F.sum(F.when(when, F.col("value") * F.col("_w"))) / F.nullif(total, F.lit(0.0))


def weight_feedback(signals: DataFrame, weights: dict[str, float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Scores per query (or ``keys``) from parsed signals: overall, relevance, helpfulness, accuracy.

    Accuracy is one minus the mean value of reports and rephrasings; reports have value 0,
    so a report alone gives accuracy 1.
    """
    keys = keys or ["query_id"]
    kind = F.col("signal_type")
    everything = F.lit(True)
    weighted = signals.withColumn("_w", _weight(weights))
    positive, negative = F.count_if(F.col("polarity") == "positive"), F.count_if(F.col("polarity") == "negative")
    totals = weighted.groupBy(*keys).agg(
        F.coalesce(_weighted(everything), F.lit(0.5)).alias("overall_score"),
        _weighted(kind.isin("dwell_time", "scroll_depth", "click", "copy")).alias("_rel"),
        _weighted(F.col("category") == "explicit").alias("_help"),
        (1 - _weighted(kind.isin("report", "rephrase"))).alias("_acc"),
        F.count("*").alias("signal_count"),
        (F.avg("confidence") * (0.7 + 0.3 * F.least(F.lit(1.0), F.count("*") / 5))).alias("confidence"),
        F.when(positive > negative * 2, "positive").when(negative > positive * 2, "negative").otherwise("neutral").alias("polarity"),
        F.max("ts").alias("ts"),
    )
    overall = F.col("overall_score")
    return totals.select(
        *keys, "overall_score",
        F.coalesce("_rel", overall).alias("relevance_score"),
        F.coalesce("_help", overall).alias("helpfulness_score"),
        F.coalesce("_acc", overall).alias("accuracy_score"),
        "signal_count", "confidence", "polarity", "ts",
    )


def filter_confidence(signals: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return signals.where(F.col("confidence") >= min_confidence)


def signals_of_chunk(signals: DataFrame, chunk_id) -> DataFrame:
    return signals.where(F.array_contains("chunk_ids", chunk_id))


def signals_of_concept(signals: DataFrame, concept_id) -> DataFrame:
    return signals.where(F.array_contains("concept_ids", concept_id))


def feedback_pattern(signals: DataFrame, key: str = "student_id") -> DataFrame:
    """Trend of the last ten signals per key: declining, improving, inconsistent or stable."""
    recent = top_k(signals, [key], [F.col("ts").desc(), F.col("signal_id").desc()], 10, "_r")
    at = lambda i: F.max(F.when(F.col("_r") == i, F.col("value")))
    stats = recent.groupBy(key).agg(
        F.count("*").alias("n"), at(1).alias("_1"), at(2).alias("_2"), at(3).alias("_3"),
        F.var_pop("value").alias("_var"), F.avg("value").alias("_avg"),
    )
    falling = (F.col("n") >= 3) & (F.col("_1") < F.col("_2")) & (F.col("_2") < F.col("_3"))
    rising = (F.col("n") >= 3) & (F.col("_1") > F.col("_2")) & (F.col("_2") > F.col("_3"))
    erratic = (F.col("n") >= 5) & (F.col("_var") > 0.2)
    choose = lambda a, b, c, d: F.when(falling, a).when(rising, b).when(erratic, c).otherwise(d)
    return stats.select(
        key, choose("declining", "improving", "inconsistent", "stable").alias("pattern"),
        choose(0.7, 0.7, 0.6, 0.5).alias("confidence"),
        choose("review_content", "continue_approach", "investigate_chunks", F.lit(None)).alias("suggestion"),
        F.when(~(falling | rising | erratic), F.col("_avg")).alias("average_score"),
    )


def quality(score: Column) -> Column:
    return (
        F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair")
        .when(score >= 0.3, "poor").otherwise("critical")
    )


def _chunk_means() -> dict:
    return {"average_score": (F.col("overall_score"), CHUNK_ALPHA, 0.5)}


def chunk_metrics(feedback: DataFrame, chunks: str = "chunk_ids", tie: str = "query_id") -> DataFrame:
    """Running score, counts and quality per chunk from scored feedback that names chunks."""
    return chunk_metrics_of(chunk_parts(feedback, chunks, tie))


def chunk_parts(feedback: DataFrame, chunks: str = "chunk_ids", tie: str = "query_id") -> DataFrame:
    """What a batch of feedback adds to each chunk it names."""
    rows = feedback.select(F.explode(chunks).alias("chunk_id"), "ts", tie, "overall_score")
    good = F.col("overall_score") >= 0.6
    counts = [F.count_if(good).alias("positive_feedback"), F.count_if(~good).alias("negative_feedback"), F.max("ts").alias("last_used")]
    return ewma_parts(rows, ["chunk_id"], "ts", tie, _chunk_means(), counts)


def chunk_metrics_of(parts: DataFrame, order: str | None = None) -> DataFrame:
    """Metrics from parts: one row per chunk, or with ``order`` those of several batches."""
    folded = ewma_fold(parts, ["chunk_id"], _chunk_means(), order) if order else parts
    totals = ewma_totals(folded, ["chunk_id"], _chunk_means())
    return totals.select(
        "chunk_id", F.col("n").alias("total_feedback"), F.col("n").alias("times_used_in_answer"),
        "positive_feedback", "negative_feedback", "average_score",
        quality(F.col("average_score")).alias("quality"),
        (F.col("average_score") < 0.4).alias("needs_review"), "last_used",
    )


def retrieval_usage(log: DataFrame) -> DataFrame:
    """Times a chunk was retrieved and used; ``log(chunk_id, used_in_answer, ts)``."""
    return log.groupBy("chunk_id").agg(
        F.count("*").alias("times_retrieved"), F.count_if("used_in_answer").alias("times_used_in_answer"),
        F.max("ts").alias("last_used"),
    )


def quality_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("quality").agg(F.count("*").alias("chunks"))


def poor_chunks(metrics: DataFrame, stored: DataFrame | None = None, threshold: float = 0.4, min_feedback: int = 3) -> DataFrame:
    """Chunks with poor scores, mostly negative feedback, or rare use; then stored poor ones not seen."""
    retrieved = F.coalesce("times_retrieved", F.lit(0)) if "times_retrieved" in metrics.columns else F.lit(0)
    enough = metrics.where(F.col("total_feedback") >= min_feedback)
    poor = enough.where(
        (F.col("average_score") < threshold)
        | (F.col("positive_feedback") / F.col("total_feedback") < 0.3)
        | ((retrieved > 10) & (F.col("times_used_in_answer") < retrieved * 0.2))
    ).select("chunk_id", "total_feedback", "positive_feedback", "negative_feedback", "average_score")
    if stored is not None:
        known = (
            stored.where((F.col("average_score") < threshold) & (F.col("total_feedback") >= min_feedback))
            .select(*poor.columns).join(poor, "chunk_id", "left_anti")
        )
        poor = poor.unionByName(known)
    return (
        poor.withColumn("quality", quality(F.col("average_score"))).withColumn("needs_review", F.lit(True))
        .orderBy("average_score", "chunk_id")
    )


def concept_metrics(signals: DataFrame, batch: str = "query_id") -> DataFrame:
    """Confusion and satisfaction per concept over its batches of parsed signals."""
    return concept_metrics_of(concept_parts(signals, batch), batch)


def concept_parts(signals: DataFrame, batch: str = "query_id") -> DataFrame:
    """Sums per concept, batch and student; sums of several calls can be added up."""
    kind = F.col("signal_type")
    mark = (
        F.when(kind == "rephrase", 2).when(kind == "followup", 1).when(kind == "thumbs_down", 2)
        .when(kind == "report", 3).when(F.col("value") < 0.4, 1).otherwise(0)
    )
    each = signals.withColumn("concept_id", F.explode("concept_ids")).withColumn("_w", _weight(None))
    return each.groupBy("concept_id", batch, "student_id").agg(
        F.sum(mark).alias("marks"), F.count("*").alias("signals"), F.sum(F.col("value") * F.col("_w")).alias("weighted"),
        F.sum("_w").alias("weight"), F.max("ts").alias("ts"),
    )


def concept_metrics_of(parts: DataFrame, batch: str = "query_id") -> DataFrame:
    """Metrics per concept from the parts of any number of calls: a batch counts once, whole, at its last signal."""
    batches = parts.groupBy("concept_id", batch).agg(
        F.least(F.lit(1.0), F.sum("marks") / (F.sum("signals") * 2)).alias("confusion"),
        F.coalesce(F.sum("weighted") / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.5)).alias("satisfaction"), F.max("ts").alias("ts"),
    )
    totals = ewma(batches, ["concept_id"], "ts", batch, {
        "confusion_score": (F.col("confusion"), CONCEPT_ALPHA, 0.0),
        "average_satisfaction": (F.col("satisfaction"), CONCEPT_ALPHA, 0.5),
    })
    # Distinct (concept, student) pairs first, so that no concept's students gather in one place.
    students = parts.select("concept_id", "student_id").where(F.col("student_id").isNotNull()).distinct().groupBy("concept_id").agg(
        F.count("*").alias("unique_students")
    )
    return totals.join(students, "concept_id", "left").select(
        "concept_id", F.col("n").alias("total_queries"), F.coalesce("unique_students", F.lit(0)).alias("unique_students"),
        "average_satisfaction", "confusion_score",
        (F.col("confusion_score") > 0.5).alias("is_confusing"),
        ((F.col("confusion_score") > 0.3) | (F.col("average_satisfaction") < 0.5)).alias("needs_improvement"),
    )


def confusing_concepts(metrics: DataFrame, stored: DataFrame | None = None, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    """Most confusing concepts: computed ones, then stored ones not among them."""
    marked = (F.col("confusion_score") >= threshold) | F.col("is_confusing")
    found = metrics.where(marked)
    if stored is not None:
        found = found.unionByName(stored.where(marked).join(found, "concept_id", "left_anti").select(*found.columns))
    return found.orderBy(F.col("confusion_score").desc(), "concept_id").limit(limit)


def system_metrics(chunks: DataFrame, concepts: DataFrame, feedback: DataFrame, query_log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row of totals, averages and problem counts for the last ``days`` before ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_interval(days=F.lit(days))
    recent = feedback.where(F.col("ts") >= start).agg(F.count("*")).scalar()
    logged = query_log.where(F.col("ts") >= start).agg(F.count("*")).scalar()
    by_concept = concepts.agg(F.struct(
        F.count("*").alias("n"), F.coalesce(F.avg("average_satisfaction"), F.lit(0.5)).alias("satisfaction"),
        F.count_if("is_confusing").alias("confusing"), F.coalesce(F.sum("total_queries"), F.lit(0)).alias("queries"),
    )).scalar()
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.avg("average_score"), F.lit(0.5)).alias("average_relevance"),
        F.count_if("needs_review").alias("poor_chunks"),
    ).select(
        "*", by_concept["n"].alias("total_concepts"), by_concept["satisfaction"].alias("average_satisfaction"),
        by_concept["confusing"].alias("confusing_concepts"),
        F.greatest(by_concept["queries"], logged).alias("total_queries"), recent.alias("total_feedback"),
    )


def trending(signals: DataFrame, as_of: str, days: int = 7, limit: int = 10, batch: str = "query_id") -> DataFrame:
    """Concepts named by most queries in the last ``days``, with their mean satisfaction."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    recent = signals.where(F.col("ts") >= start).withColumn("concept_id", F.explode("concept_ids"))
    per_query = weight_feedback(recent, keys=["concept_id", batch])
    return (
        per_query.groupBy("concept_id")
        .agg(F.count("*").alias("total_queries"), F.avg("overall_score").alias("satisfaction"))
        .orderBy(F.col("total_queries").desc(), "concept_id").limit(limit)
    )


def engagement(signals: DataFrame) -> DataFrame:
    """Reading and interaction measures per query, with an engagement score of four parts."""
    kind = F.col("signal_type")
    last = lambda k: F.coalesce(
        F.max_by("raw_value", F.when(kind == k, F.struct("ts", "signal_id"))), F.lit(0.0)
    )
    totals = signals.groupBy("query_id").agg(
        F.max_by("student_id", F.struct("ts", "signal_id")).alias("student_id"), F.max("ts").alias("ts"),
        last("dwell_time").alias("dwell_time_seconds"), last("scroll_depth").alias("scroll_depth_percent"),
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "copy").alias("copies"),
        F.count_if(kind == "followup").alias("followup_questions"),
    )
    parts = (
        F.least(F.lit(1.0), F.col("dwell_time_seconds") / 60) + F.col("scroll_depth_percent") / 100
        + F.least(F.lit(1.0), F.col("clicks") / 3) + F.least(F.lit(1.0), F.col("copies").cast("double"))
    )
    scores = weight_feedback(signals).select("query_id", F.col("overall_score").alias("satisfaction_score"))
    return totals.withColumn("engagement_score", parts / 4).join(scores, "query_id")


def student_engagement(engaged: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return engaged.where(F.col("ts") >= start).groupBy("student_id").agg(
        F.count("*").alias("total_queries"), F.avg("dwell_time_seconds").alias("avg_dwell_time"),
        F.avg("scroll_depth_percent").alias("avg_scroll_depth"), F.sum("clicks").alias("total_clicks"),
        F.sum("copies").alias("total_copies"), F.avg("engagement_score").alias("avg_engagement_score"),
        F.avg("satisfaction_score").alias("avg_satisfaction_score"),
    )


def student_summary(explicit: DataFrame, implicit: DataFrame, as_of: str, days: int = 30, recent: int = 5) -> DataFrame:
    """Per student: interactions, share found helpful, preferred complexity, newest explicit feedback."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    said = explicit.where((F.col("created_at") > start) & F.col("student_id").isNotNull())
    done = implicit.where((F.col("ts") > start) & F.col("student_id").isNotNull())
    kind = F.col("feedback_type")
    by_words = said.groupBy("student_id").agg(
        F.count("*").alias("_e"), *[F.count_if(kind == k).alias(k) for k in ("helpful", "not_helpful", "too_complex", "too_simple")]
    )
    by_acts = done.groupBy("student_id").agg(F.count("*").alias("_i"))
    newest = (
        top_k(said, ["student_id"], [F.col("created_at").desc(), F.col("feedback_id").desc()], recent, "_r")
        .groupBy("student_id")
        .agg(F.sort_array(F.collect_list(F.struct("_r", F.col("feedback_type").alias("type"), "rating", F.col("created_at").alias("date")))).alias("recent_feedback"))
    )
    judged = F.col("helpful") + F.col("not_helpful")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by_words.join(by_acts, "student_id", "full").join(newest, "student_id", "left").select(
        "student_id", (zero("_e") + zero("_i")).alias("total_interactions"),
        F.when(judged > 0, F.col("helpful") / F.nullif(judged, F.lit(0))).otherwise(0.5).alias("helpful_ratio"),
        F.when(F.col("too_complex") > F.col("too_simple"), "simpler")
        .when(F.col("too_simple") > F.col("too_complex"), "advanced").otherwise("intermediate").alias("preferred_complexity"),
        F.coalesce("recent_feedback", F.array()).alias("recent_feedback"),
    )


def content_summary(explicit: DataFrame) -> DataFrame:
    """Per content: ratios, complexity counts, common issues and suggested improvements."""
    kind = F.col("feedback_type")
    totals = explicit.groupBy(F.col("query_id").alias("content_id")).agg(
        F.count("*").alias("total_feedback"),
        F.count_if(kind == "helpful").alias("appropriate"),
        F.count_if(kind.isin("not_helpful", "incorrect", "incomplete")).alias("_neg"),
        F.count_if(kind == "too_complex").alias("too_complex"), F.count_if(kind == "too_simple").alias("too_simple"),
    )
    n, hard, easy = F.col("total_feedback"), F.col("too_complex"), F.col("too_simple")
    negative = F.col("_neg") / n
    return totals.select(
        "content_id", "total_feedback", (F.col("appropriate") / n).alias("positive_ratio"), negative.alias("negative_ratio"),
        "too_complex", "too_simple", "appropriate",
        F.array_compact(F.array(
            F.when(hard > n * 0.3, "Contenido demasiado complejo para muchos usuarios"),
            F.when(easy > n * 0.3, "Contenido demasiado simple para muchos usuarios"),
            F.when(negative > 0.5, "Alto ratio de feedback negativo"),
        )).alias("common_issues"),
        F.array_compact(F.array(
            F.when(hard > easy, "Simplificar explicaciones"), F.when(hard > easy, "Agregar más ejemplos"),
            F.when(easy > hard, "Agregar contenido más avanzado"),
        )).alias("suggested_improvements"),
    )


def content_engagement(explicit: DataFrame, implicit: DataFrame) -> DataFrame:
    """Per content: views, verdicts, dwell, scroll, click rate and a score (scroll as measured)."""
    said = explicit.groupBy(F.col("query_id").alias("content_id")).agg(
        F.count_if(F.col("feedback_type") == "helpful").alias("helpful_count"),
        F.count_if(F.col("feedback_type") != "helpful").alias("not_helpful_count"),
    )
    kind = F.col("signal_type")
    named = implicit.withColumn("content_id", F.col("query_id"))
    done = named.groupBy("content_id").agg(
        F.avg(F.when(kind == "dwell_time", F.coalesce("raw_value", F.lit(0.0)))).alias("_dwell"),
        F.avg(F.when(kind == "scroll_depth", F.coalesce("raw_value", F.lit(0.0)))).alias("_scroll"),
        F.count_if(kind == "click").alias("_clicks"),
    )
    views = named.select("content_id", "student_id").where(F.col("student_id").isNotNull()).distinct().groupBy("content_id").agg(
        F.count("*").alias("_views")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = said.join(done, "content_id", "full").join(views, "content_id", "left").select(
        "content_id", zero("_views").alias("total_views"), zero("helpful_count").alias("helpful_count"),
        zero("not_helpful_count").alias("not_helpful_count"),
        zero("_dwell").alias("avg_dwell_time_seconds"), zero("_scroll").alias("avg_scroll_depth"),
        F.coalesce(F.try_divide(zero("_clicks"), zero("_views")), F.lit(0.0)).alias("click_through_rate"),
    )
    judged = F.col("helpful_count") + F.col("not_helpful_count")
    ratio = F.coalesce(F.try_divide(F.col("helpful_count"), judged), F.lit(0.5))
    return joined.withColumn(
        "engagement_score",
        ratio * 0.3 + F.least(F.lit(1.0), F.col("avg_dwell_time_seconds") / 60) * 0.3
        + F.col("avg_scroll_depth") * 0.2 + F.col("click_through_rate") * 0.2,
    )


def explicit_to_signals(explicit: DataFrame) -> DataFrame:
    """Explicit feedback as parsed signals."""
    kind = F.coalesce(_lookup(FEEDBACK_SIGNAL, F.col("feedback_type")), F.lit("thumbs_down"))
    return parse_signals(explicit.select(
        F.col("feedback_id").alias("signal_id"), kind.alias("signal_type"), F.col("rating").cast("double").alias("raw_value"),
        "query_id", "student_id", F.col("created_at").alias("ts"), "feedback_type",
    ))


def recent_feedback(explicit: DataFrame, feedback_type: str | None = None, limit: int = 50) -> DataFrame:
    """Newest explicit feedback, ``limit`` rows."""
    rows = explicit if feedback_type is None else explicit.where(F.col("feedback_type") == feedback_type)
    return rows.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).limit(limit)
