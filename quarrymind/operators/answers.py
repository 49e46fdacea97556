"""Scoring of logged answers, the decision it leads to, and checks against mode specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.functions.text import two_decimals, words
from quarrymind.operators.routing import contains_any

# Marks looked for in answers.
DEFINITION_MARKS = ["es ", "son ", "se define", "significa", "consiste en", "is ", "are ", "means", "refers to"]
RESULT_MARKS = ["resultado", "respuesta", "solución", "result", "answer", "solution"]
EXERCISE_MARKS = ["ejercicio", "problema", "exercise", "problem"]
EXPLANATION_MARKS = [
    "para resolver", "se resuelve", "la solución es", "primero", "segundo", "paso", "entonces", "porque", "debido a",
    "ya que", "to solve", "the solution", "first", "then", "because", "procedimiento", "método", "fórmula",
]
# Weight of each dimension in the overall score.
DIMENSIONS = {"mode_alignment": 0.35, "prohibition_check": 0.25, "content_quality": 0.20, "context_coverage": 0.10, "format_compliance": 0.10}

# Fixed values per mode: requirements as (name, description, required, weight, marks) and
# prohibitions as (name, description, penalty, marks).
SPECS = {
    "concept": (
        [
            ("definición", "Definición clara del concepto", True, 1.5,
             ["es", "se define", "significa", "consiste en", "se refiere", "representa", "es un", "es una"]),
            ("explicación", "Explicación del concepto", True, 1.0,
             ["porque", "debido", "por lo tanto", "esto significa", "es decir", "en otras palabras", "implica"]),
            ("relaciones", "Relaciones con otros conceptos (si aplica)", False, 0.5,
             ["relaciona", "conecta", "depende", "implica", "causa", "similar", "diferente", "contrario"]),
        ],
        [],
    ),
    "practice": (
        [
            ("identificación", "Identificación del problema y datos", True, 1.0,
             ["problema", "ejercicio", "datos", "dado", "encontrar", "calcular", "determinar", "hallar"]),
            ("pasos", "Pasos de resolución numerados", True, 1.5,
             ["paso", "1.", "2.", "primero", "luego", "después", "siguiente", "a continuación", "finalmente"]),
            ("justificación", "Justificación de cada paso", True, 1.0,
             ["porque", "ya que", "dado que", "aplicamos", "utilizamos", "según", "de acuerdo"]),
            ("resultado", "Resultado final claro", True, 1.5,
             ["resultado", "respuesta", "solución", "obtenemos", "=", "igual a", "es igual", "por lo tanto"]),
        ],
        [("respuesta_sin_proceso", "Dar respuesta directa sin mostrar proceso", 0.4, [])],
    ),
    "exercise_list": (
        [
            ("lista", "Lista de ejercicios con formato", True, 2.0, ["ejercicio", "problema", "📝", "•", "-", "1.", "2.", "3."]),
            ("metadatos", "Metadatos de cada ejercicio (dificultad, concepto)", True, 1.0,
             ["dificultad", "concepto", "ref", "tipo", "nivel", "tema"]),
        ],
        [
            ("explicación_procedimiento", "Explicaciones de cómo resolver", 0.5,
             ["para resolver", "el primer paso", "se calcula", "aplicamos", "utilizamos la fórmula", "sustituyendo",
              "resolviendo", "operando", "simplificando"]),
            ("explicación_teórica", "Explicaciones teóricas o conceptuales extensas", 0.3,
             ["esto significa", "por lo tanto", "debido a", "la razón es", "porque", "ya que", "dado que"]),
            ("pasos_resolución", "Pasos de resolución de ejercicios", 0.5,
             ["paso 1", "paso 2", "primero", "luego", "después", "a continuación", "finalmente obtenemos"]),
            ("pistas_solución", "Pistas o hints sobre cómo resolver", 0.3,
             ["pista", "hint", "sugerencia", "recuerda que", "ten en cuenta", "considera"]),
        ],
    ),
}
# Weights of the named qualities when judging an answer of each mode.
EVALUATION_WEIGHTS = {
    "concept": {"relevance": 0.30, "coverage": 0.25, "coherence": 0.15, "completeness": 0.15, "mode_alignment": 0.15},
    "practice": {"relevance": 0.25, "coverage": 0.20, "coherence": 0.20, "completeness": 0.15, "mode_alignment": 0.20},
    "exercise_list": {"relevance": 0.20, "coverage": 0.15, "coherence": 0.15, "completeness": 0.10, "mode_alignment": 0.40},
}


# Patterns of steps, lists and structure, and the texts of decisions.
STEP_MARKS = r"(paso|step|\d+[\.\)])"
LIST_MARKS = r"(?U)(\d+[\.\)]\s|\-\s|•)"
NUMBERED_STEPS = r"(?dU)(\d+[\.\)]\s.+\n?){2,}"
NUMBERED, BULLETS = r"\d+[\.\)]", r"[\-\*•]"
REASONS = {
    "forbidden": "Violación de prohibiciones en EXERCISE_LIST",
    "forbidden_spent": "Max retries alcanzado con violaciones",
    "mismatch": "Modo esperado: ",
    "mismatch_spent": "Max retries con mode mismatch",
    "thin": "Necesita más contexto",
    "good": "Score aceptable: ",
    "low": "Score bajo: ",
    "spent": "Máximo de reintentos alcanzado",
}
PROHIBITIONS = ["NO explicar procedimientos", "NO dar soluciones", "SOLO listar ejercicios"]
LOW_FOCUS = "Mejorar alineación con el modo y calidad"


def _alignment(answer: Column, n_words: Column) -> Column:
    low = F.lower(answer)
    points = lambda ok, value: F.when(ok, value).otherwise(0.0)
    concept = points(contains_any(low, DEFINITION_MARKS), 0.5) + points(n_words > 50, 0.5)
    practice = points(low.rlike(STEP_MARKS), 0.6) + points(contains_any(low, RESULT_MARKS), 0.4)
    listing = (
        points(answer.rlike(LIST_MARKS), 0.4) + points(contains_any(low, EXERCISE_MARKS), 0.3)
        + F.when(n_words < 300, 0.3).otherwise(-0.3)
    )
    mode = F.col("mode")
    return F.when(mode == "concept", concept).when(mode == "practice", practice).when(
        mode == "exercise_list", F.greatest(F.lit(0.0), F.least(F.lit(1.0), listing))
    ).otherwise(0.5)


def _violations(answer: Column, n_words: Column) -> Column:
    low = F.lower(answer)
    found = sum((F.contains(low, F.lit(m)).cast("int") for m in EXPLANATION_MARKS), (n_words > 200).cast("int"))
    return F.when(F.col("mode") == "exercise_list", found).otherwise(0)


def context_coverage(answers: DataFrame, contexts: DataFrame, leading: int = 5) -> DataFrame:
    """Share of context concepts named and of the ``leading`` chunks used, per query.

    ``contexts(query_id, rank, content, concepts)`` are the hits an answer was built from.
    Chunks are compared row by row with their query's answer; only counts are grouped.
    """
    asked = answers.select("query_id", F.lower("answer").alias("_a"))
    joined = contexts.join(asked, "query_id")
    named = (
        joined.select("query_id", "_a", F.explode("concepts").alias("c"))
        .select("query_id", F.lower(F.col("c").cast("string")).alias("c"), F.contains(F.col("_a"), F.lower(F.col("c").cast("string"))).alias("_in"))
        .distinct().groupBy("query_id").agg(F.count("*").alias("_nc"), F.count_if("_in").alias("concepts_mentioned"))
    )
    shared = F.size(F.array_intersect(words(F.lower("content")), words(F.col("_a"))))
    used = joined.groupBy("query_id").agg(
        F.count("*").alias("context_count"), F.count_if((F.col("rank") <= leading) & (shared > 3)).alias("chunks_used")
    )
    return used.join(named, "query_id", "left").select(
        "query_id", "context_count", "chunks_used", F.coalesce("concepts_mentioned", F.lit(0)).alias("concepts_mentioned"),
        (
            0.5 * F.coalesce("concepts_mentioned", F.lit(0)) / F.greatest(F.coalesce("_nc", F.lit(0)), F.lit(1))
            + 0.5 * F.col("chunks_used") / F.least("context_count", F.lit(leading))
        ).alias("context_coverage"),
    )


def score_answers(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Five dimension scores, which of them pass, and the weighted overall score.

    ``answers(query_id, query, answer, mode)``.
    """
    n = F.col("answer_words")
    answer, mode = F.col("answer"), F.col("mode")
    terms, own = F.array_distinct(words(F.lower("query"))), F.array_distinct(words(F.lower("answer")))
    steps = answer.rlike(NUMBERED_STEPS)
    structured = answer.rlike(NUMBERED) | answer.rlike(BULLETS) | F.contains(answer, F.lit("\n\n"))
    scored = (
        answers.join(context_coverage(answers, contexts), "query_id", "left")
        .withColumn("answer_words", F.size(words("answer")))
        .withColumn("mode_alignment", _alignment(answer, n))
        .withColumn(
            "content_quality",
            F.least(F.lit(1.0), n / 50) * 0.4
            + F.size(F.array_intersect(terms, own)) / F.greatest(F.size(terms), F.lit(1)) * 0.6,
        )
        .withColumn("context_coverage", F.coalesce("context_coverage", F.lit(0.5)))
        .withColumn(
            "format_compliance",
            F.when(mode == "exercise_list", F.when(steps, 0.8).otherwise(0.4))
            .when(mode == "practice", F.when(steps, 0.9).otherwise(0.5))
            .otherwise(F.when(structured, 0.7).otherwise(0.5)),
        )
        .withColumn("violations", _violations(answer, n))
        .withColumn("prohibition_check", F.greatest(F.lit(0.0), 1.0 - F.col("violations") * 0.2))
    )
    overall = sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0))
    concise = (mode != "exercise_list") | (n < 300)
    return (
        scored.withColumn("overall_score", F.round(overall, 9))
        .withColumn("mode_passed", (F.round("mode_alignment", 9) >= 0.5) & concise)
        .withColumn("prohibitions_passed", F.col("violations") < 3)
        .withColumn("mode_aligned", F.col("mode_passed") & F.col("prohibitions_passed"))
    )


def decide(scores: DataFrame, max_retries: int = 3, retries: str = "retries") -> DataFrame:
    """Decision per scored answer with its reason and hints for the next attempt."""
    can, mode = F.col(retries) < max_retries, F.col("mode")
    forbidden = ~F.col("prohibitions_passed") & (mode == "exercise_list")
    mismatch = ~F.col("mode_passed")
    thin = F.col("context_coverage") < 0.2
    good = F.col("overall_score") >= 0.6
    score_text = two_decimals("overall_score")
    said = {stage: F.lit(text) for stage, text in REASONS.items()}
    stage = (
        F.when(forbidden, "forbidden").when(mismatch, "mismatch").when(thin & can, "thin")
        .when(good, "good").when(can, "low").otherwise("spent")
    )
    at = F.col("_stage")
    return (
        scores.withColumn("_stage", stage)
        .withColumn(
            "decision",
            F.when(at == "forbidden", F.when(can, "retry").otherwise("fallback"))
            .when(at == "mismatch", F.when(can, "mode_mismatch").otherwise("fallback"))
            .when(at == "thin", "request_more_context").when(at == "good", "accept").when(at == "low", "retry").otherwise("fallback"),
        )
        .withColumn(
            "decision_reason",
            F.when(at == "forbidden", F.when(can, said["forbidden"]).otherwise(said["forbidden_spent"]))
            .when(at == "mismatch", F.when(can, F.concat(said["mismatch"], mode)).otherwise(said["mismatch_spent"]))
            .when(at == "thin", said["thin"]).when(at == "good", F.concat(said["good"], score_text))
            .when(at == "low", F.concat(said["low"], score_text)).otherwise(said["spent"]),
        )
        .withColumn("expand_context", ~at.isin("forbidden", "mismatch") & thin)
        .withColumn("increase_top_k", F.col("expand_context"))
        .withColumn("decrease_temperature", at.isin("forbidden", "low"))
        .withColumn("suggested_mode", F.when((at == "mismatch") & mode.isin("practice", "exercise_list"), mode))
        .withColumn(
            "add_prohibitions",
            F.when(at == "forbidden", F.array(*[F.lit(p) for p in PROHIBITIONS]))
            .otherwise(F.array().cast("array<string>")),
        )
        .withColumn("retry_focus", F.when(at == "low", LOW_FOCUS).otherwise(""))
        .withColumn("should_retry", can & F.col("decision").isin("retry", "mode_mismatch", "request_more_context"))
        .drop("_stage")
    )


def validate_answers(answers: DataFrame) -> DataFrame:
    """Score, issues and suggestions of each answer against its mode's specification."""
    low = F.lower("answer")
    score, issues, suggestions = F.lit(1.0), [], []
    for mode, (requirements, prohibitions) in SPECS.items():
        active = F.col("mode") == mode
        total = sum(weight for _, _, required, weight, _ in requirements if required)
        for name, description, required, weight, marks in requirements:
            if required:
                missing = active & ~contains_any(low, marks)
                score = score - F.when(missing, weight / total * 0.4).otherwise(0.0)
                issues.append(F.when(missing, f"Falta: {name}"))
                suggestions.append(F.when(missing, f"Incluir: {description}"))
        for name, description, penalty, marks in prohibitions:
            hit = active & contains_any(low, marks)
            score = score - F.when(hit, penalty).otherwise(0.0)
            issues.append(F.when(hit, f"Prohibido: {name}"))
            suggestions.append(F.when(hit, f"Eliminar: {description}"))
    return (
        answers.withColumn("spec_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        .withColumn("issues", F.array_compact(F.array(*issues)))
        .withColumn("suggestions", F.array_compact(F.array(*suggestions)))
    )


def weighted_quality(qualities: DataFrame) -> DataFrame:
    """Mean of the named qualities, weighted as each mode prescribes."""
    total = F.lit(None).cast("double")
    for mode, weights in EVALUATION_WEIGHTS.items():
        value = sum((F.col(name) * w for name, w in weights.items()), F.lit(0.0))
        total = F.when(F.col("mode") == mode, value).otherwise(total)
    return qualities.withColumn("weighted_quality", total)


def qa_report(log: DataFrame) -> DataFrame:
    """Answers per mode and final decision, with iterations, mode changes and expansions."""
    return log.groupBy("mode", "final_decision").agg(
        F.count("*").alias("answers"), F.avg("iterations").alias("avg_iterations"),
        F.sum("mode_changes").alias("mode_changes"), F.sum("retrieval_expansions").alias("retrieval_expansions"),
    )
