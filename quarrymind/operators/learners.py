"""Learner profiles: mastery, levels, weaknesses and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.operators.ranking import ewma_fold, ewma_parts, ewma_totals, first_per_key, top_k

QUALITY_ALPHA, MASTERY_ALPHA = 0.1, 0.2

# Settings per level, as (complexity, depth, analogies, vocabulary, chunk size).
LEVELS = {
    "beginner": (0.3, "detailed", True, "simple", "small"),
    "elementary": (0.5, "moderate", True, "basic", "medium"),
    "intermediate": (0.7, "standard", False, "intermediate", "medium"),
    "advanced": (0.9, "concise", False, "advanced", "large"),
    "expert": (1.0, "brief", False, "technical", "large"),
}


def profiles(students: DataFrame, student_concept: DataFrame) -> DataFrame:
    """Students with their concept mastery as a map and their accuracy rate."""
    entry = F.struct("concept_id", F.struct("mastery_score", "interactions", "last_reviewed", "is_weakness"))
    mastered = student_concept.groupBy("student_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("concept_mastery"), F.avg("mastery_score").alias("avg_mastery")
    )
    return (
        students.join(mastered, "student_id", "left")
        .withColumn("accuracy_rate", F.coalesce(F.try_divide("correct_answers", "total_questions"), F.lit(0.0)))
        .withColumn("avg_mastery", F.coalesce("avg_mastery", F.lit(0.0)))
    )


def _quality_mean() -> dict:
    return {"average_response_quality": (F.col("score"), QUALITY_ALPHA, 0.0)}


def _mastery_mean() -> dict:
    return {"mastery_score": (F.col("score"), MASTERY_ALPHA, None)}


def profile_parts(interactions: DataFrame, tie: str = "interaction_id") -> DataFrame:
    """What a batch of interactions adds to each student."""
    scored = interactions.where(F.col("score").isNotNull())
    counts = [F.count_if(F.col("score") >= 0.7).alias("correct_answers"), F.max("ts").alias("last_active")]
    return ewma_parts(scored, ["student_id"], "ts", tie, _quality_mean(), counts)


def profiles_of(parts: DataFrame, order: str | None = None) -> DataFrame:
    """Totals per student from parts; with ``order`` those of several batches."""
    folded = ewma_fold(parts, ["student_id"], _quality_mean(), order) if order else parts
    return ewma_totals(folded, ["student_id"], _quality_mean()).withColumnRenamed("n", "total_questions")


def update_profiles(interactions: DataFrame, stored: DataFrame | None = None, tie: str = "interaction_id") -> DataFrame:
    """Question counts, correct answers (score at least 0.7) and running answer quality per student.

    With ``stored`` the totals continue from each student's present values.
    """
    fresh = profiles_of(profile_parts(interactions, tie))
    if stored is None:
        return fresh
    old = stored.select(
        "student_id", F.col("total_questions").alias("_q"), F.col("correct_answers").alias("_c"),
        F.col("average_response_quality").alias("_a"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    carried = F.pow(F.lit(1 - QUALITY_ALPHA), zero("total_questions")) * F.coalesce("_a", F.lit(0.0))
    return fresh.join(old, "student_id", "full").select(
        "student_id", (F.coalesce("average_response_quality", F.lit(0.0)) + carried).alias("average_response_quality"),
        (zero("total_questions") + zero("_q")).alias("total_questions"),
        (zero("correct_answers") + zero("_c")).alias("correct_answers"), "last_active",
    )


def mastery(interactions: DataFrame, tie: str = "interaction_id") -> DataFrame:
    """Mastery per student and concept: the first score, then a running mean of the later ones."""
    return mastery_of(mastery_parts(interactions, tie))


def mastery_parts(interactions: DataFrame, tie: str = "interaction_id") -> DataFrame:
    """What a batch of interactions adds to each student and concept."""
    scored = interactions.where(F.col("score").isNotNull())
    return ewma_parts(scored, ["student_id", "concept_id"], "ts", tie, _mastery_mean(), [F.max("ts").alias("last_reviewed")])


def mastery_of(parts: DataFrame, order: str | None = None) -> DataFrame:
    """Mastery from parts; with ``order`` those of several batches."""
    keys = ["student_id", "concept_id"]
    totals = ewma_totals(ewma_fold(parts, keys, _mastery_mean(), order) if order else parts, keys, _mastery_mean())
    low = F.col("mastery_score") < 0.4
    return totals.select(
        "student_id", "concept_id", "mastery_score", F.col("n").alias("interactions"), "last_reviewed",
        F.when(F.col("n") == 1, low).otherwise(low & (F.col("n") >= 3)).alias("is_weakness"),
    )


def level_of(accuracy: Column, avg_mastery: Column) -> Column:
    score = accuracy * 0.4 + avg_mastery * 0.6
    return (
        F.when(score >= 0.9, "expert").when(score >= 0.75, "advanced").when(score >= 0.5, "intermediate")
        .when(score >= 0.25, "elementary").otherwise("beginner")
    )


def levels(profile: DataFrame) -> DataFrame:
    return profile.withColumn("level", level_of(F.col("accuracy_rate"), F.col("avg_mastery")))


def weaknesses(student_concept: DataFrame, interactions: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Weak concepts per student: low or fading mastery, repeated confusion, unmet prerequisites."""
    days = F.floor(F.timestamp_diff("SECOND", F.col("last_reviewed"), F.lit(as_of).cast("timestamp")) / 86400)
    m = F.col("mastery_score")
    low = F.col("is_weakness") | ((m < 0.4) & (F.col("interactions") >= 2))
    fading = ((days > 7) & (m < 0.7)) | ((days > 30) & (m < 0.85))
    known = student_concept.where(low | fading).select("student_id", "concept_id")
    confused = (
        interactions.where(F.coalesce(F.col("confused"), F.lit(False)) | (F.coalesce("score", F.lit(1.0)) < 0.5))
        .groupBy("student_id", "concept_id").agg(F.count("*").alias("n")).where("n >= 2").select("student_id", "concept_id")
    )
    weak = known.unionByName(confused).distinct()
    shaky = student_concept.join(weak.withColumn("_w", F.lit(True)), ["student_id", "concept_id"], "left").where(
        (m < 0.5) | F.col("_w")
    ).select("student_id", "concept_id")
    needs = edges.where(F.col("edge_type") == "prerequisite").select(F.col("src").alias("needed"), F.col("dst").alias("concept_id")).distinct()
    held = student_concept.select("student_id", F.col("concept_id").alias("needed"), F.col("mastery_score").alias("_held"))
    gaps = (
        shaky.join(needs, "concept_id").select("student_id", "needed").distinct()
        .join(held, ["student_id", "needed"], "left")
        .where(F.col("_held").isNull() | (F.col("_held") < 0.6))
        .select("student_id", F.col("needed").alias("concept_id"))
    )
    return weak.unionByName(gaps).distinct()


def recommend(weak: DataFrame, student_concept: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` concepts per student: weaknesses first, then the least mastered others."""
    first = weak.select("student_id", "concept_id", F.lit(0).alias("_p"), F.lit(0.0).alias("_m"))
    then = student_concept.select("student_id", "concept_id", F.lit(1).alias("_p"), F.col("mastery_score").alias("_m"))
    once = first.unionByName(then).groupBy("student_id", "concept_id").agg(F.min(F.struct("_p", "_m")).alias("o"))
    return top_k(once, ["student_id"], [F.col("o._p"), F.col("o._m"), F.col("concept_id")], k).select(
        "student_id", "concept_id", "rank"
    )


def with_level_config(profile: DataFrame) -> DataFrame:
    """Add the settings of each profile's level; an unknown level reads as intermediate."""
    names = ("max_complexity", "explanation_depth", "use_analogies", "vocabulary_level", "chunk_size")
    out = profile
    for i, name in enumerate(names):
        pairs = [F.lit(x) for level, values in LEVELS.items() for x in (level, values[i])]
        out = out.withColumn(
            name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("level")), F.lit(LEVELS["intermediate"][i]))
        )
    return out


def new_profiles(log: DataFrame, students: DataFrame, as_of: str) -> DataFrame:
    """Default profiles for students in the log who have none yet."""
    stamp = F.lit(as_of).cast("timestamp")
    return log.select("student_id").where(F.col("student_id").isNotNull()).distinct().join(students, "student_id", "left_anti").select(
        "student_id", F.lit("beginner").alias("level"), F.lit("reading").alias("learning_style"),
        F.lit(0).alias("total_sessions"), F.lit(0).alias("total_questions"), F.lit(0).alias("correct_answers"),
        F.lit(0.0).alias("average_response_quality"), stamp.alias("created_at"),
    )
