"""Normalise, combine, de-duplicate and select ranked hits.

Hits are long rows ``(query_id, source, rank, doc_id, score)`` and may carry ``content``.
``rank`` is the place of a hit in its source's list for the query, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymind.functions import text as tx
from quarrymind.functions.rows import unfold
from quarrymind.operators.ranking import number_rows, top_k

# Share of each source in weighted fusion, and of any other source.
WEIGHTS = {"vector": 0.5, "bm25": 0.3, "graph": 0.2}
OTHER_WEIGHT = 0.1
RRF_K = 60
SOURCES = ("vector", "bm25", "graph")

_LIST = ["query_id", "source"]


def normalize_scores(hits: DataFrame, method: str = "minmax") -> DataFrame:
    """Add ``norm`` in [0, 1] per query and source by min-max, z-score or rank."""
    if method == "rank":
        # Scores are bucketed in steps of 1/1000, which grow with the ranking order.
        numbered = number_rows(
            hits, _LIST, -F.floor(F.col("score") * 1000), [F.col("score").desc(), F.col("rank")], "_pos"
        )
        sizes = hits.groupBy(*_LIST).agg(F.count("*").alias("_n"))
        return numbered.join(sizes, _LIST).withColumn(
            "norm", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((F.col("_n") - F.col("_pos")) / (F.col("_n") - 1))
        ).drop("_pos", "_n")
    if method == "zscore":
        stats = hits.groupBy(*_LIST).agg(F.avg("score").alias("_a"), F.stddev_pop("score").alias("_b"))
        z = (F.col("score") - F.col("_a")) / F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.lit(1.0))
        norm = 1 / (1 + F.exp(-z))
    else:
        stats = hits.groupBy(*_LIST).agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
        span = F.col("_b") - F.col("_a")
        norm = F.when(span == 0, F.lit(0.5)).otherwise((F.col("score") - F.col("_a")) / F.nullif(span, F.lit(0.0)))
    return hits.join(stats, _LIST).withColumn("norm", norm).drop("_a", "_b")


def _weight_of(weights: dict[str, float] | None, hits: DataFrame) -> Column:
    """Weight of a hit's source: per-row columns ``<source>_weight`` win over the mapping."""
    chosen = {**WEIGHTS, **(weights or {})}
    out = F.lit(OTHER_WEIGHT)
    for source, weight in chosen.items():
        column = f"{source}_weight"
        value = F.col(column) if column in hits.columns else F.lit(float(weight))
        out = F.when(F.col("source") == source, value).otherwise(out)
    return out


def fuse(
    hits: DataFrame, method: str = "weighted", weights: dict[str, float] | None = None, normalization: str | None = "minmax",
    min_final: float = 0.0, max_results: int = 10, rrf_k: int = RRF_K,
) -> DataFrame:
    """Combine the sources' hits: ``(query_id, doc_id, final_score, <source>_score…, sources, rank)``.

    Weighted fusion filters by ``min_final`` and then limits; reciprocal-rank and maximum
    fusion limit first.
    """
    if method == "rrf":
        parts = hits.withColumn("norm", 1 / (F.lit(float(rrf_k)) + F.col("rank")))
        total = F.sum("norm")
    elif method == "max":
        parts = normalize_scores(hits, normalization) if normalization else hits.withColumn("norm", F.col("score"))
        total = F.max("norm")
    else:
        parts = normalize_scores(hits, normalization) if normalization else hits.withColumn("norm", F.col("score"))
        parts = parts.withColumn("_w", _weight_of(weights, hits))
        total = F.sum(F.col("norm") * F.col("_w"))
    # A source that lists a document twice: the total adds both, its own score keeps the last.
    own = (lambda s: F.max(F.when(F.col("source") == s, F.col("norm")))) if method == "max" else (
        lambda s: F.max_by("norm", F.when(F.col("source") == s, F.col("rank")))
    )
    aggregates = [
        F.round(total, 9).alias("final_score"),
        *[F.coalesce(own(s), F.lit(0.0)).alias(f"{s}_score") for s in SOURCES],
        F.sort_array(F.collect_set("source")).alias("sources"),
    ]
    if "content" in hits.columns:
        place = F.when(F.col("source") == "vector", 0).when(F.col("source") == "bm25", 1).otherwise(2)
        aggregates.append(F.min_by("content", F.struct(place, F.col("rank"))).alias("content"))
    fused = parts.groupBy("query_id", "doc_id").agg(*aggregates)
    order = [F.col("final_score").desc(), F.col("doc_id")]
    if method in ("rrf", "max"):
        return top_k(fused, ["query_id"], order, max_results).where(F.col("final_score") >= min_final)
    return top_k(fused.where(F.col("final_score") >= min_final), ["query_id"], order, max_results)


def adapt_weights(hits: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    """Per query, the mean of each base weight and the source's share of the hits."""
    base = {**WEIGHTS, **(base or {})}
    counts = hits.groupBy("query_id").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("source") == s).alias(f"_{s}") for s in SOURCES]
    )
    return counts.select(
        "query_id",
        *[((F.lit(float(base[s])) + F.col(f"_{s}") / F.col("_n")) / 2).alias(f"{s}_weight") for s in SOURCES],
    )


def select_top_k(hits: DataFrame, k: int = 10, min_score: float = 0.0, score: str = "final_score") -> DataFrame:
    kept = hits.where(F.col(score) >= min_score)
    return top_k(kept, ["query_id"], [F.col(score).desc(), F.col("doc_id")], k)


def _listed(hits: DataFrame, content: str, extra: list[str]) -> DataFrame:
    """One row per query with its hits in rank order; lists are as short as the hit limit."""
    item = F.struct("rank", "doc_id", *extra, F.array_distinct(tx.words(F.lower(F.col(content)))).alias("words"))
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Sets of too different a size cannot share that much; tested before comparing words."""
    return F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * (threshold - 1e-9)


def dedup_hits(hits: DataFrame, threshold: float = 0.9, content: str = "content") -> DataFrame:
    """Walk each query's ranked hits and drop those too similar to any kept before.

    Input hits are the limited lists of :func:`fuse`. Returns the kept hits re-ranked.
    """
    kept = F.aggregate(
        "items",
        F.slice("items", 1, 0),
        lambda acc, h: F.when(
            F.exists(acc, lambda k: _may_reach(k["words"], h["words"], threshold) & (tx.jaccard_sets(k["words"], h["words"]) >= threshold)), acc
        ).otherwise(F.concat(acc, F.array(h))),
    )
    listed = _listed(hits, content, [])
    survivors = unfold(listed, ["query_id"], kept, "k", "pos").select(
        "query_id", F.col("k.doc_id").alias("doc_id"), (F.col("pos") + 1).alias("rank")
    )
    return hits.drop("rank").join(survivors, ["query_id", "doc_id"])


def mmr(hits: DataFrame, k: int = 10, penalty: float = 0.3, content: str = "content", score: str = "final_score", min_score: float = 0.0) -> DataFrame:
    """Pick ``k`` hits per query, each the best of score minus penalty × likeness to those picked.

    Input hits are limited lists. Every candidate carries its likeness so far, so a pick
    compares the rest with the newest choice only.
    """
    listed = _listed(hits.where(F.col(score) >= min_score).withColumn("_s", F.col(score)), content, ["_s"])
    pool = F.transform(
        "items",
        lambda h: F.struct(h["rank"], h["doc_id"], h["_s"].alias("s"), h["words"], F.lit(0.0).alias("sim")),
    )
    start = F.struct(F.slice("items.doc_id", 1, 0).alias("picked"), pool.alias("pool"))

    def pick(acc: Column, _: Column) -> Column:
        best = F.array_max(F.transform(acc["pool"], lambda c: F.struct((c["s"] - penalty * c["sim"]).alias("v"), (-c["rank"]).alias("r"))))
        return tx.bind(
            F.element_at(F.filter(acc["pool"], lambda c: c["rank"] == -best["r"]), 1),
            lambda chosen: F.struct(
                F.concat(acc["picked"], F.array(chosen["doc_id"])).alias("picked"),
                F.transform(
                    F.filter(acc["pool"], lambda c: c["rank"] != chosen["rank"]),
                    lambda c: F.struct(
                        c["rank"], c["doc_id"], c["s"], c["words"],
                        F.greatest(c["sim"], tx.jaccard_sets(c["words"], chosen["words"])).alias("sim"),
                    ),
                ).alias("pool"),
            ),
        )

    rounds = F.sequence(F.lit(1), F.least(F.lit(k), F.size("items")))
    chosen = F.aggregate(rounds, start, pick, lambda acc: acc["picked"])
    survivors = unfold(listed, ["query_id"], chosen, "doc_id", "pos").select(
        "query_id", "doc_id", (F.col("pos") + 1).alias("rank")
    )
    return hits.drop("rank").join(survivors, ["query_id", "doc_id"])


def apply_boosts(hits: DataFrame, boosts: dict[str, float], metadata: str = "metadata", score: str = "final_score") -> DataFrame:
    """Multiply scores by the factor of every truthy JSON metadata field, and rank again."""
    factor = F.lit(1.0)
    for path, boost in boosts.items():
        value = F.get_json_object(metadata, "$." + path.replace("metadata.", ""))
        truthy = value.isNotNull() & ~value.isin("", "false", "0", "0.0", "null", "[]", "{}")
        factor = factor * F.when(truthy, F.lit(float(boost))).otherwise(F.lit(1.0))
    boosted = hits.withColumn(score, F.col(score) * factor).drop("rank")
    return number_rows(boosted, ["query_id"], -F.floor(F.col(score) * 1000), [F.col(score).desc(), F.col("doc_id")])


def build_context(hits: DataFrame, max_tokens: int = 8000, content: str = "content") -> DataFrame:
    """Per query, ranked contents within the token budget as one text with their scores."""
    cost = tx.estimate_tokens(content)
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.withColumn("_used", F.sum(cost).over(running)).where(F.col("_used") <= max_tokens)
    two = lambda c: tx.two_decimals(F.col(c))
    named = [
        F.when(F.col(f"{s}_score") > 0, F.concat(F.lit(f"{s}: "), two(f"{s}_score"))) for s in SOURCES if f"{s}_score" in hits.columns
    ]
    parts = F.concat_ws(", ", *named) if named else F.lit("")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] (score: "), two("final_score"), F.lit(", "),
        F.when(F.length(parts) > 0, parts).otherwise(F.lit("combined")), F.lit(")\n"), F.col(content),
    )
    return (
        kept.withColumn("_block", block)
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("rank", "_block"))).alias("_b"),
            F.count("*").alias("n_hits"), F.max("_used").alias("tokens"),
        )
        .select("query_id", "n_hits", "tokens", F.array_join(F.col("_b._block"), "\n\n---\n\n").alias("context"))
    )


def format_context(hits: DataFrame, n: int = 8, cut: int = 800, content: str = "content") -> DataFrame:
    """Prompt text per query: the first chunks, each cut, with source and up to three concepts."""
    source = F.when(F.length("source_id") > 0, F.concat(F.lit(" (Fuente: "), F.col("source_id"), F.lit(")"))).otherwise(F.lit(""))
    named = F.slice("concepts", 1, 3)
    concepts = F.when(F.size("concepts") > 0, F.concat(F.lit(" [Conceptos: "), F.array_join(named, ", "), F.lit("]"))).otherwise(F.lit(""))
    first = hits.where(F.col("rank") <= n)
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("]"), source, concepts, F.lit("\n"), F.substring(content, 1, cut),
        F.when(F.length(content) > cut, F.lit("...")).otherwise(F.lit("")),
    )
    return (
        first.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("_b"), F.count("*").alias("n_hits"))
        .select("query_id", "n_hits", F.array_join(F.col("_b.b"), "\n\n").alias("context"))
    )


def format_exercises(hits: DataFrame) -> DataFrame:
    """Prompt list per query: one line per exercise with difficulty and up to three concepts."""
    named = F.when(F.size("concepts") > 0, F.array_join(F.slice("concepts", 1, 3), ", ")).otherwise(F.lit("general"))
    line = F.concat(
        F.lit("- "), F.coalesce("exercise_title", F.concat(F.lit("Ejercicio "), F.col("rank").cast("string"))),
        F.lit(" (Dificultad: "), F.coalesce("difficulty", F.lit("medio")), F.lit(") - Conceptos: "), named,
    )
    return (
        hits.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
        .select("query_id", F.array_join(F.col("_l.line"), "\n").alias("listing"))
    )
