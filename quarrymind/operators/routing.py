"""Learning-mode detection over query tables, and the retrieval strategy per mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.functions.text import two_decimals, words

MODES = ("concept", "practice", "exercise_list")

# Patterns and keywords that speak for each mode.
EXERCISE_PATTERNS = [
    r"\b(dame|muestra|lista|enumera|presenta)\s+(los\s+)?(ejercicios|problemas|prácticas)\b",
    r"\b(ejercicios|problemas)\s+(de|sobre|para)\b",
    r"\b(qué|cuáles)\s+(ejercicios|problemas)\s+(hay|tiene|existen)\b",
    r"\blista\s+de\s+(ejercicios|problemas|prácticas)\b",
    r"\bejercicio[s]?\s+(disponible|relacionado)[s]?\b",
    r"\bmuéstrame\s+(ejercicios|problemas)\b",
    r"\bquiero\s+(ejercicios|problemas|practicar)\b",
    r"\bnecesito\s+(ejercicios|problemas|práctica)\b",
    r"\btiene[s]?\s+(ejercicios|problemas)\b",
    r"\bpráctica\s+(de|sobre|para)\b",
    r"\bejemplos\s+de\s+ejercicios\b",
    r"\b(give|show|list|enumerate)\s+(me\s+)?(exercises|problems|practice)\b",
    r"\b(exercises|problems)\s+(on|about|for)\b",
    r"\b(what|which)\s+(exercises|problems)\s+(are|do)\b",
    r"\blist\s+of\s+(exercises|problems)\b",
    r"\bi\s+(want|need)\s+(exercises|problems|practice)\b",
]
EXERCISE_KEYWORDS = [
    "ejercicios", "problemas", "práctica", "dame ejercicios", "lista de ejercicios", "muestra ejercicios",
    "ejercicios disponibles", "exercises", "problems", "practice problems", "show exercises",
]
PRACTICE_PATTERNS = [
    r"\b(cómo|como)\s+(se\s+)?(resuelve|resolver|soluciona|solucionar|hace|hacer)\b",
    r"\bresuelve\s+(este|el|un|una|la)\b",
    r"\b(explica|explicar)\s+(cómo|como)\s+(se\s+)?(resuelve|resolver)\b",
    r"\bpaso\s+a\s+paso\b",
    r"\bpaso\s+por\s+paso\b",
    r"\bejemplo\s+(resuelto|de\s+solución)\b",
    r"\bsolución\s+(de|del|detallada)\b",
    r"\bresolver\s+(este|el|un|una)\s+(problema|ejercicio)\b",
    r"\b(muestra|explica)\s+(el|un)\s+(procedimiento|proceso)\b",
    r"\bcálculo\s+de\b",
    r"\bdesarrollo\s+de\b",
    r"\b(demuestra|demostrar|demostración)\b",
    r"\bhow\s+(do\s+)?(i|you|we)\s+(solve|calculate|find|compute)\b",
    r"\bsolve\s+(this|the|a|an)\b",
    r"\bstep[\s-]by[\s-]step\b",
    r"\bworked\s+(example|solution)\b",
    r"\bshow\s+(me\s+)?(how|the\s+solution)\b",
    r"\bwalk\s+(me\s+)?through\b",
    r"\bexplain\s+how\s+to\b",
]
PRACTICE_KEYWORDS = [
    "cómo resolver", "como resolver", "resuelve", "paso a paso", "ejemplo resuelto", "solución detallada",
    "procedimiento", "how to solve", "step by step", "worked example", "show me how", "resolver el ejercicio",
    "resolver el problema",
]
CONCEPT_PATTERNS = [
    r"\b(qué|que)\s+(es|son|significa)\b",
    r"\b(define|definir|definición)\b",
    r"\b(explica|explicar)\s+(qué|que|el|la|los|las)\b",
    r"\bconcepto\s+de\b",
    r"\b(teoría|teórico|teórica)\b",
    r"\brelación\s+entre\b",
    r"\bdiferencia\s+entre\b",
    r"\bcaracterísticas\s+de\b",
    r"\bpropiedades\s+de\b",
    r"\btipos\s+de\b",
    r"\bclasificación\s+de\b",
    r"\bfundamentos\b",
    r"\bprincipios\b",
    r"\bwhat\s+(is|are|does)\b",
    r"\bdefine\b",
    r"\b(explain|describe)\s+(what|the)\b",
    r"\bconcept\s+of\b",
    r"\b(theory|theoretical)\b",
    r"\brelationship\s+between\b",
    r"\bdifference\s+between\b",
    r"\bcharacteristics\s+of\b",
    r"\bproperties\s+of\b",
]
MARKS = {
    "concept": (CONCEPT_PATTERNS, []),
    "practice": (PRACTICE_PATTERNS, PRACTICE_KEYWORDS),
    "exercise_list": (EXERCISE_PATTERNS, EXERCISE_KEYWORDS),
}

# Phrases that ask for another mode, and what each asks for.
SWITCH_PHRASES = [
    "cambiar a modo", "switch to mode", "modo concepto", "modo práctica", "modo ejercicios",
    "quiero ver ejercicios", "explícame la teoría", "resuelve paso a paso",
]
SWITCH_WORDS = {
    "concept": ["concepto", "teoría", "concept", "theory"],
    "practice": ["práctica", "paso", "practice", "step"],
    "exercise_list": ["ejercicio", "lista", "exercise", "list"],
}

# Retrieval settings per mode, as (chunk type, metadata only, expand concepts,
# top k, minimum score, vector weight, bm25 weight, graph weight).
STRATEGIES = {
    "concept": (None, False, True, 10, 0.3, 0.35, 0.25, 0.4),
    "practice": ("worked_example", False, True, 10, 0.3, 0.45, 0.15, 0.4),
    "exercise_list": ("exercise", True, True, 20, 0.1, 0.0, 0.0, 1.0),
}
BASIC_STRATEGIES = {
    "concept": (None, False, True, 10, 0.3, 0.35, 0.25, 0.4),
    "practice": ("worked_example", False, True, 10, 0.3, 0.4, 0.3, 0.3),
    "exercise_list": ("exercise", True, False, 20, 0.1, 0.5, 0.5, 0.0),
}
STRATEGY_FIELDS = [
    "chunk_type_filter", "metadata_only", "expand_concepts", "top_k", "min_score",
    "vector_weight", "bm25_weight", "graph_weight",
]


# Points of a pattern and of a keyword, thresholds and bonuses of the modes, and the hints used when none is reached.
PATTERN_POINTS, KEYWORD_POINTS, PREVIOUS_BONUS = 0.4, 0.3, 0.1
THRESHOLDS = {"exercise_list": 0.5, "practice": 0.5, "concept": 0.3}
EXERCISE_HINTS = ["ejercicio", "problema", "práctica", "exercise", "problem"]
SOLVING_HINTS = ["cómo", "como", "resolver", "resuelve", "solve", "how"]
HOW_HINTS = ["cómo", "como", "how"]
SHORT_QUERY_WORDS, SHORT_QUERY_HINTS, SHORT_QUERY_BONUS = 5, ["ejercicio", "problema", "práctica"], 0.2
NUMBERS, NUMBERS_BONUS = r"\d+|\+|\-|\*|\/|=", 0.15
DEFINES, DEFINES_BONUS = r"(?U)(qué|que)\s+(es|son|significa)|define|definición", 0.3


def contains_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def _matches(text: Column, mode: str) -> Column:
    patterns, keywords = MARKS[mode]
    found = [F.when(text.rlike("(?iU)" + p), F.lit(f"pattern:{p[:30]}...")) for p in patterns]
    found += [F.when(F.contains(text, F.lit(k)), F.lit(f"keyword:{k}")) for k in keywords]
    return F.array_compact(F.array(*found))


def _base_score(matches: Column) -> Column:
    by_pattern = F.size(F.filter(matches, lambda m: F.startswith(m, F.lit("pattern:"))))
    return F.least(F.lit(1.0), by_pattern * PATTERN_POINTS + (F.size(matches) - by_pattern) * KEYWORD_POINTS)


def _choose(scores: dict[str, Column], text: Column) -> Column:
    """Winning mode by threshold in order of priority, else by plain hints."""
    exercise, solving = contains_any(text, EXERCISE_HINTS), contains_any(text, SOLVING_HINTS)
    reached = {mode: scores[mode] >= least for mode, least in THRESHOLDS.items()}
    return (
        F.when(reached["exercise_list"], "exercise_list")
        .when(reached["practice"], "practice")
        .when(reached["concept"], "concept")
        .when(exercise, F.when(solving, "practice").otherwise("exercise_list"))
        .when(contains_any(text, HOW_HINTS), "practice")
        .otherwise("concept")
    )


def _scored(queries: DataFrame, col: str) -> DataFrame:
    """Adjusted scores per mode, before the continuity bonus."""
    named = queries.withColumn("_q", F.lower(F.trim(col)))
    text = F.col("_q")
    named = named.withColumns({f"_m_{m}": _matches(text, m) for m in MODES})
    short = (F.size(words(text)) <= SHORT_QUERY_WORDS) & contains_any(text, SHORT_QUERY_HINTS)
    bonus = {
        "exercise_list": F.when(short, SHORT_QUERY_BONUS).otherwise(0.0),
        "practice": F.when(text.rlike(NUMBERS), NUMBERS_BONUS).otherwise(0.0),
        "concept": F.when(text.rlike(DEFINES), DEFINES_BONUS).otherwise(0.0),
    }
    return named.withColumns({f"_s_{m}": _base_score(F.col(f"_m_{m}")) + bonus[m] for m in MODES})


def _final(previous: Column) -> dict[str, Column]:
    """Scores with 0.1 more for the previous mode, capped and rid of rounding noise."""
    return {
        m: F.round(F.least(F.lit(1.0), F.col(f"_s_{m}") + F.when(previous == m, PREVIOUS_BONUS).otherwise(0.0)), 9) for m in MODES
    }


def classify_mode(queries: DataFrame, col: str = "text") -> DataFrame:
    """Add mode, confidence, matched patterns, reason and the three scores.

    An optional ``previous_mode`` column gives that mode a small bonus.
    """
    previous = F.col("previous_mode") if "previous_mode" in queries.columns else F.lit(None).cast("string")
    scored = _scored(queries, col)
    final = _final(previous)
    scored = scored.withColumns({f"{m}_score": final[m] for m in MODES})
    scored = scored.withColumn("mode", _choose({m: F.col(f"{m}_score") for m in MODES}, F.col("_q")))
    pick = lambda cols: F.when(F.col("mode") == "concept", cols["concept"]).when(F.col("mode") == "practice", cols["practice"]).otherwise(cols["exercise_list"])
    own = pick({m: F.col(f"{m}_score") for m in MODES})
    others = pick({m: F.greatest(*[F.col(f"{o}_score") for o in MODES if o != m]) for m in MODES})
    matched = pick({m: F.col(f"_m_{m}") for m in MODES})
    scored = scored.withColumn("matched_patterns", matched).withColumn("_own", own)
    n = F.size("matched_patterns")
    summary = F.concat(
        F.array_join(F.slice("matched_patterns", 1, 3), ", "),
        F.when(n > 3, F.concat(F.lit(" (+"), (n - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit("")),
    )
    reason = F.when(
        n == 0, F.concat(F.lit("Default mode ("), F.col("mode"), F.lit(") - no strong patterns detected"))
    ).otherwise(F.concat(F.lit("Detected "), F.col("mode"), F.lit(" (score="), two_decimals("_own"), F.lit("): "), summary))
    out = scored.withColumn(
        "confidence", F.when(F.col("_own") > 0, F.least(F.lit(1.0), F.col("_own") - others + 0.5)).otherwise(F.lit(0.5))
    ).withColumn("reason", reason)
    return out.drop("_q", "_own", *[f"_m_{m}" for m in MODES], *[f"_s_{m}" for m in MODES])


def with_previous_mode(queries: DataFrame, col: str = "text", session: str = "session_id", turn: str = "turn_no", block: int = 500) -> DataFrame:
    """Add the mode detected for the query before it in the session.

    The mode of one query depends on the one before, so each query is first turned into a
    table from the four possible previous modes to its own mode. Such tables chain:
    blocks of turns are walked separately for all four starting points, and one entry per
    block then fixes where each block starts.
    """
    scored = _scored(queries, col)
    starts = ("none", *MODES)
    outcomes = F.array(*[_choose(_final(F.lit(s)), F.col("_q")) for s in starts])
    mapped = scored.select(session, turn, F.floor(F.col(turn) / block).alias("_block"), outcomes.alias("o"))
    by_block = mapped.groupBy(session, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), "o"))).alias("steps"))
    index_of = lambda mode: F.array_position(F.array(*[F.lit(s) for s in starts]), mode).cast("int")

    def walk(start: str) -> Column:
        """Mode before each turn of the block, and the mode after its last, from ``start``."""
        init = F.struct(F.lit(start).alias("mode"), F.array().cast("array<string>").alias("seen"))
        return F.aggregate("steps", init, lambda acc, s: F.struct(
            F.element_at(s["o"], index_of(acc["mode"])).alias("mode"), F.concat(acc["seen"], F.array(acc["mode"])).alias("seen"),
        ))

    walked = by_block.select(session, "_block", "steps", F.array(*[walk(s) for s in starts]).alias("w"))
    ends = walked.select(session, "_block", F.transform("w", lambda x: x["mode"]).alias("e"))
    init = F.struct(F.lit("none").alias("mode"), F.array().cast("array<struct<b:bigint,mode:string>>").alias("out"))
    entries = (
        ends.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col("_block").alias("b"), "e"))).alias("blocks"))
        .select(session, F.explode(F.aggregate("blocks", init, lambda acc, x: F.struct(
            F.element_at(x["e"], index_of(acc["mode"])).alias("mode"),
            F.concat(acc["out"], F.array(F.struct(x["b"].alias("b"), acc["mode"].alias("mode")))).alias("out"),
        ), lambda acc: acc["out"])).alias("x"))
        .select(session, F.col("x.b").alias("_block"), F.col("x.mode").alias("_entry"))
    )
    before = (
        walked.join(entries, [session, "_block"])
        .select(session, F.explode(F.arrays_zip(
            F.transform("steps", lambda s: s["t"]).alias("t"), F.element_at("w", index_of(F.col("_entry")))["seen"].alias("mode")
        )).alias("z"))
        .select(session, F.col("z.t").alias(turn), F.nullif(F.col("z.mode"), F.lit("none")).alias("previous_mode"))
    )
    return queries.join(before, [session, turn], "left")


def mode_switch(queries: DataFrame, col: str = "text") -> DataFrame:
    """Add ``switch_mode``: the mode a query explicitly asks to change to, or null."""
    text = F.lower(F.col(col))
    asked = F.when(contains_any(text, SWITCH_WORDS["concept"]), "concept").when(
        contains_any(text, SWITCH_WORDS["practice"]), "practice"
    ).when(contains_any(text, SWITCH_WORDS["exercise_list"]), "exercise_list")
    return queries.withColumn("switch_mode", F.when(contains_any(text, SWITCH_PHRASES), asked))


def effective_mode(queries: DataFrame, col: str = "text") -> DataFrame:
    """Mode in force: forced, else explicitly switched to, else detected."""
    detected = mode_switch(classify_mode(queries, col), col)
    forced = F.col("forced_mode") if "forced_mode" in queries.columns else F.lit(None).cast("string")
    certain = F.coalesce(forced, F.col("switch_mode"))
    return detected.withColumn("confidence", F.when(certain.isNotNull(), F.lit(1.0)).otherwise(F.col("confidence"))).withColumn(
        "reason", F.when(forced.isNotNull(), "forced_mode").when(F.col("switch_mode").isNotNull(), "explicit_mode_switch").otherwise(F.col("reason"))
    ).withColumn("mode", F.coalesce(certain, F.col("mode")))


def mode_feasible(queries: DataFrame, counts: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Whether the tenant holds content for the mode; ``counts(tenant, content_type, n)``."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("content_type") == kind, F.col("n"))), F.lit(0)).alias(f"_{kind}")
    held = counts.groupBy(tenant).agg(*[of(k) for k in ("exercise", "worked_example", "concept", "definition", "chunk")])
    n = lambda kind: F.coalesce(F.col(f"_{kind}"), F.lit(0))
    text = lambda kind: n(kind).cast("string")
    feasible = F.when(F.col("mode") == "exercise_list", n("exercise") > 0).when(
        F.col("mode") == "practice", (n("worked_example") > 0) | (n("exercise") > 0)
    ).otherwise(n("chunk") > 0)
    good = F.when(F.col("mode") == "exercise_list", F.concat(text("exercise"), F.lit(" ejercicios disponibles"))).when(
        F.col("mode") == "practice", F.concat(text("worked_example"), F.lit(" ejemplos resueltos, "), text("exercise"), F.lit(" ejercicios"))
    ).otherwise(F.concat(text("concept"), F.lit(" conceptos, "), text("definition"), F.lit(" definiciones")))
    bad = F.when(F.col("mode") == "exercise_list", "No hay ejercicios disponibles en los documentos cargados").when(
        F.col("mode") == "practice", "No hay ejemplos resueltos o ejercicios disponibles"
    ).otherwise("No hay contenido conceptual disponible")
    joined = queries.join(held, tenant, "left").withColumn("feasible", feasible)
    return joined.withColumn("message", F.when(F.col("feasible"), good).otherwise(bad)).drop(
        "_exercise", "_worked_example", "_concept", "_definition", "_chunk"
    )


def strategy_for(queries: DataFrame, variant: str = "spec") -> DataFrame:
    """Add the retrieval settings of each query's mode and the strategy they amount to.

    ``variant='basic'`` uses the second settings table, which names practice hybrid and
    leaves the graph out of exercise lists.
    """
    table = STRATEGIES if variant == "spec" else BASIC_STRATEGIES
    out = queries
    for i, field in enumerate(STRATEGY_FIELDS):
        pairs = [F.lit(x) for mode, values in table.items() for x in (mode, values[i])]
        out = out.withColumn(field, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("mode")), F.lit(table["concept"][i])))
    return out.withColumn(
        "strategy",
        F.when(F.col("metadata_only"), "metadata_only").when(F.col("graph_weight") >= 0.4, "graph_enhanced").otherwise("hybrid"),
    )


def expand_strategy(strategies: DataFrame, flag: str = "more_context") -> DataFrame:
    """Widen the settings of flagged queries: five more results, a lower minimum score."""
    wide = F.col(flag)
    return (
        strategies.withColumn("top_k", F.when(wide, F.least(F.lit(30), F.col("top_k") + 5)).otherwise(F.col("top_k")))
        .withColumn("min_score", F.when(wide, F.greatest(F.lit(0.1), F.col("min_score") - 0.1)).otherwise(F.col("min_score")))
        .withColumn("expand_concepts", F.when(wide, F.lit(True)).otherwise(F.col("expand_concepts")))
    )
