"""Concept-graph traversal, construction and feedback-driven weight upkeep.

Edges are rows ``(edge_type, src, dst, weight, confidence, negative_signals)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymind.functions.rows import unfold
from quarrymind.functions.text import two_decimals
from quarrymind.operators.ranking import number_rows, top_k
from quarrymind.session import cut_lineage, small_side

DECAY = 0.8
EXPAND_TYPES = ("relates_to", "prerequisite", "similar_to")
EVIDENCE = "evidenced_by"
# Bloom filters of nodes: places of a node, and the largest filter in words of 64 bits (beyond it more nodes pass in vain).
MARK_PLACES, MARK_BITS, MARK_WORDS = 3, 8, 512


def neighbors(edges: DataFrame, types: tuple[str, ...] | None = None, min_weight: float = 0.0) -> DataFrame:
    """Both directions of every edge as ``(node_id, neighbor_id, edge_type, weight)``, without loops.

    Type and weight conditions sit on the scan; one pass emits both directions.
    """
    kept = edges.where((F.col("weight") >= min_weight) & (F.col("src") != F.col("dst")))
    if types is not None:
        kept = kept.where(F.col("edge_type").isin(*types))
    ends = F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("neighbor_id")),
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("neighbor_id")),
    )
    return kept.select(F.explode(ends).alias("e"), "edge_type", "weight").select(
        "e.node_id", "e.neighbor_id", "edge_type", "weight"
    )


def _around(frontier: DataFrame, edges: DataFrame, types: tuple[str, ...] | None, min_weight: float) -> DataFrame:
    """``(at, neighbor_id, weight, edge_type)`` of the frontier's nodes; only their edges are aggregated."""
    wanted = small_side(frontier.select("node_id").distinct())
    near = neighbors(edges, types, min_weight).join(wanted, "node_id", "left_semi")
    return near.groupBy(F.col("node_id").alias("at"), "neighbor_id").agg(F.max("weight").alias("weight"), F.min("edge_type").alias("edge_type"))


def expand(
    seeds: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int | None = 30, min_weight: float = 0.3,
    types: tuple[str, ...] = EXPAND_TYPES,
) -> DataFrame:
    """Best-scoring nodes around each seed set, with the path that reached them.

    ``seeds(query_id, node_id)``. A node scores the product of ``weight * 0.8`` along its
    path. Each level joins the frontier with the edges of its nodes and keeps one best path per
    (query, node), so the frontier is bounded by nodes and not by walks. ``max_nodes`` None keeps all.
    """
    level = seeds.select(
        "query_id", "node_id", F.lit(1.0).alias("score"), F.lit(0).alias("depth"), F.array("node_id").alias("path")
    ).distinct()
    reached = level
    if depth > 1:
        followed = edges.where((F.col("weight") >= min_weight) & F.col("edge_type").isin(*types))
        edges = cut_lineage(followed.select("edge_type", "src", "dst", "weight"), "edges")
    for d in range(1, depth + 1):
        adjacent = _around(level, edges, types, min_weight)
        step = (
            level.join(adjacent, level["node_id"] == adjacent["at"])
            .where(~F.array_contains("path", F.col("neighbor_id")))
            .select(
                "query_id", F.col("neighbor_id").alias("node_id"),
                F.round(F.col("score") * F.col("weight") * DECAY, 9).alias("score"),
                F.concat("path", F.array("neighbor_id")).alias("path"),
            )
            .groupBy("query_id", "node_id")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b"))
            .select("query_id", "node_id", (-F.col("b.s")).alias("score"), F.lit(d).alias("depth"), F.col("b.path").alias("path"))
        )
        if d < depth:
            step = cut_lineage(step, "frontier")
        level = step
        reached = reached.unionByName(step)
    best = (
        reached.groupBy("query_id", "node_id")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "path")).alias("b"))
        .select("query_id", "node_id", (-F.col("b.s")).alias("score"), F.col("b.depth").alias("depth"), F.col("b.path").alias("path"))
    )
    order = [F.col("score").desc(), F.col("depth"), F.col("node_id")]
    if max_nodes is None:
        # All nodes of a query may be many: they are numbered by score, not sorted in one task.
        numbered = number_rows(cut_lineage(best, "best"), ["query_id"], -F.floor(F.col("score") * 1000), order)
        return cut_lineage(numbered, "reached")
    # Stored, so that what is joined to the few reached nodes need not move.
    return cut_lineage(top_k(best, ["query_id"], order, max_nodes), "reached")


def evidence(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks that support the reached nodes: ``(query_id, chunk_id, node_id, relevance)``."""
    links = edges.where(F.col("edge_type") == EVIDENCE).select(
        F.col("src").alias("node_id"), F.col("dst").alias("chunk_id"), F.col("weight").alias("relevance")
    )
    return reached.select("query_id", "node_id").join(links, "node_id").select("query_id", "chunk_id", "node_id", "relevance")


def graph_hits(reached: DataFrame, edges: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieval hits from a traversal: supporting chunks, then described nodes.

    ``chunks(chunk_id, content)``; hits are ``(query_id, kind, item_id, content, score)``.
    """
    supported = evidence(reached, edges).join(chunks, "chunk_id").select(
        "query_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), "content",
        F.coalesce("relevance", F.lit(0.5)).alias("score"),
    )
    described = reached.join(nodes, "node_id").where(F.length("description") > 0).select(
        "query_id", F.lit("concept").alias("kind"), F.col("node_id").alias("item_id"),
        F.col("description").alias("content"), "score",
    )
    return supported.unionByName(described)


def _marked(walks: DataFrame) -> DataFrame:
    """(source, target, marks): a Bloom filter of the nodes where the walks of each pair end, of at least ``MARK_BITS`` bits a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("ends")
            size = ends.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = np.minimum(1 << np.ceil(np.log2(np.maximum(size * MARK_BITS / 64, 1))).astype(np.int64), MARK_WORDS)
            start = np.concatenate([[0], np.cumsum(words)])
            flat = ends.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            first, mask = np.repeat(start[:-1], size), np.repeat(64 * words - 1, size)
            marks = np.zeros(start[-1], np.uint64)
            for i in range(MARK_PLACES):
                place = (flat >> np.uint64(20 * i)).astype(np.int64) & mask
                np.bitwise_or.at(marks, first + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), batch.column("target"), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(marks.view(np.int64)))],
                names=["source", "target", "marks"],
            )

    listed = walks.groupBy("source", "target").agg(F.collect_set(F.xxhash64(F.element_at("nodes", -1))).alias("ends"))
    kinds = [f"{c} {walks.schema[c].dataType.simpleString()}" for c in ("source", "target")]
    return listed.mapInArrow(run, ", ".join([*kinds, "marks array<long>"]))


def _may_hold(marks: str, hashed: str) -> Column:
    """Whether the filter may hold the node of this hash; never false for a node that it holds."""
    held = F.lit(True)
    for i in range(MARK_PLACES):
        place = F.shiftright(hashed, 20 * i).bitwiseAND((F.size(marks) * 64 - 1).cast("long"))
        word = F.element_at(marks, F.shiftright(place, 6).cast("int") + 1)
        held = held & (F.getbit(word, place.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return held


def paths_between(pairs: DataFrame, edges: DataFrame, max_len: int = 4, min_weight: float = 0.1) -> DataFrame:
    """All simple paths of at most ``max_len`` edges between ``pairs(source, target)``.

    Walks half way from each end and meets in the middle, so only half-length walks are
    ever enumerated. Each level is written once, and only edges of its end nodes are read. With an odd ``max_len`` the last
    step forward serves paths of that length alone: it keeps only walks that end, by a Bloom filter of each pair, where a
    walk from the other end may, and the meeting decides. Node scores are the products of the weights up to the node.
    """
    pairs = cut_lineage(pairs.select("source", "target").distinct(), "pairs")
    # Read by every level, so edges that are themselves the result of a job are made once.
    edges = cut_lineage(edges.where(F.col("weight") >= min_weight).select("edge_type", "src", "dst", "weight"), "edges")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def walks(start: str, avoid: str, steps: int, met: DataFrame | None = None) -> list[DataFrame]:
        level = pairs.select(
            "source", "target", F.array(start).alias("nodes"), none("string").alias("types"), none("double").alias("weights")
        )
        levels = [level]
        for step in range(1, steps + 1):
            end = F.element_at("nodes", -1)
            open_walks = level.where(end != F.col(avoid))
            adjacent = _around(open_walks.select(end.alias("node_id")), edges, None, min_weight)
            on = end == F.col("at")
            if step == steps and met is not None:
                open_walks = open_walks.join(small_side(_marked(met)), ["source", "target"])
                adjacent = adjacent.withColumn("hashed", F.xxhash64("neighbor_id"))
                on = on & _may_hold("marks", "hashed")
            level = cut_lineage(
                open_walks.join(adjacent, on)
                .where(~F.array_contains("nodes", F.col("neighbor_id")))
                .select(
                    "source", "target",
                    F.concat("nodes", F.array("neighbor_id")).alias("nodes"),
                    F.concat("types", F.array("edge_type")).alias("types"),
                    F.concat("weights", F.array("weight")).alias("weights"),
                ),
                "walks",
            )
            levels.append(level)
        return levels

    backward = walks("target", "source", max_len // 2)
    forward = walks("source", "target", -(-max_len // 2), backward[-1] if max_len % 2 else None)
    found = None
    for length in range(0, max_len + 1):
        left = forward[-(-length // 2)].withColumn("meet", F.element_at("nodes", -1))
        right = backward[length // 2].select(
            "source", "target", F.element_at("nodes", -1).alias("meet"),
            F.reverse("nodes").alias("r_nodes"), F.reverse("types").alias("r_types"), F.reverse("weights").alias("r_weights"),
        )
        tail = F.slice("r_nodes", 2, F.greatest(F.size("r_nodes") - 1, F.lit(0)))
        joined = (
            left.join(right, ["source", "target", "meet"])
            .where(~F.arrays_overlap("nodes", tail))
            .select(
                "source", "target", F.concat("nodes", tail).alias("nodes"),
                F.concat("types", "r_types").alias("types"), F.concat("weights", "r_weights").alias("weights"),
            )
        )
        found = joined if found is None else found.unionByName(joined)
    scores = F.aggregate(
        "weights", F.array(F.lit(1.0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) * w))
    )
    return found.select(
        "source", "target", "nodes", "types", F.size("nodes").alias("length"), scores.alias("node_scores")
    )


def rank_paths(paths: DataFrame, method: str = "weighted", nodes: DataFrame | None = None) -> DataFrame:
    """Score paths by mean node score, shortness or variety of node types, and rank per pair."""
    if method == "weighted":
        score = F.aggregate("node_scores", F.lit(0.0), lambda acc, s: acc + s) / F.size("nodes")
        scored = paths.withColumn("total_score", F.round(score, 9))
    elif method == "shortest":
        scored = paths.withColumn("total_score", F.round(1.0 / (F.col("length") + 1), 9))
    elif method == "coverage":
        paths = cut_lineage(paths, "found")  # read twice
        types = (
            paths.select("source", "target", "nodes", F.explode("nodes").alias("node_id"))
            .join(nodes.select("node_id", "node_type"), "node_id")
            .groupBy("source", "target", "nodes")
            .agg((F.countDistinct("node_type") / 5).alias("total_score"))
        )
        scored = paths.join(types, ["source", "target", "nodes"], "left").fillna({"total_score": 0.0})
    else:
        raise ValueError(f"unknown path ranking: {method}")
    order = [F.col("total_score").desc(), F.col("length"), F.col("nodes")]
    # Many paths share a score; their second node, which comes next in the order, spreads them.
    bucket = F.struct((-F.floor(F.col("total_score") * 1000)).alias("s"), "length", F.get("nodes", F.lit(1)).alias("second"))
    return number_rows(cut_lineage(scored, "paths"), ["source", "target"], bucket, order)


def limit_depth(reached: DataFrame, max_depth: int) -> DataFrame:
    return reached.where(F.col("depth") <= max_depth)


def limit_path_length(paths: DataFrame, max_depth: int) -> DataFrame:
    return paths.where(F.col("length") <= max_depth + 1)


def prune(reached: DataFrame, min_score: float = 0.1) -> DataFrame:
    return reached.where(F.col("score") >= min_score)


def related(concepts: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 10, types: tuple[str, ...] | None = None) -> DataFrame:
    """Strongest neighbours of each concept with their type, weight and name."""
    asked = concepts.select("node_id").distinct()
    found = neighbors(edges, types).join(small_side(asked), "node_id", "left_semi").distinct()
    named = found.join(nodes.select(F.col("node_id").alias("neighbor_id"), "name"), "neighbor_id")
    return top_k(named, ["node_id"], [F.col("weight").desc(), F.col("neighbor_id"), F.col("edge_type")], limit)


def subgraph(centers: DataFrame, edges: DataFrame, radius: int = 2, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around each center set and the distinct edges of the paths that reached them."""
    reached = expand(centers, edges, radius, max_nodes)
    hops = F.zip_with(
        F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1),
        lambda a, b: F.struct(a.alias("src"), b.alias("dst")),
    )
    links = (
        unfold(reached.where(F.size("path") > 1), ["query_id"], hops, "h")
        .select("query_id", "h.src", "h.dst", F.lit("relates_to").alias("edge_type")).distinct()
    )
    return reached, links


# ---------------------------------------------------------------- building

def make_edges(df: DataFrame, edge_type: str, src: str = "src", dst: str = "dst", weight: float = 1.0, confidence: float = 0.8) -> DataFrame:
    """Edge rows of one type; present weight, confidence and order columns win over the defaults."""
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    extra = [F.col("order_index")] if "order_index" in df.columns else []
    return df.select(
        F.lit(edge_type).alias("edge_type"), F.col(src).alias("src"), F.col(dst).alias("dst"),
        own("weight", weight).alias("weight"), own("confidence", confidence).alias("confidence"),
        F.lit(0).alias("negative_signals"), *extra,
    )


def add_weight(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the summed ``deltas(src, edge_type, dst, delta)`` to the weights."""
    summed = deltas.groupBy("src", "edge_type", "dst").agg(F.sum("delta").alias("_d"))
    return edges.join(summed, ["src", "edge_type", "dst"], "left").withColumn(
        "weight", F.col("weight") + F.coalesce("_d", F.lit(0.0))
    ).drop("_d").select(*edges.columns)


# ---------------------------------------------------------------- feedback

# Step sizes, bounds and score bands of weight upkeep.
REINFORCE_STEP, REINFORCE_MIN, WEIGHT_CAP = 0.05, 0.6, 1.0
WEAKEN_STEP, WEAKEN_MAX, WEIGHT_FLOOR = 0.08, 0.4, 0.1
REVIEW_BELOW, REEMBED_MAX, REEMBED_PRIORITY = 0.2, 0.25, 2
MISSING_WEIGHT = 0.5


def feedback_band(score: Column) -> Column:
    return F.when(score >= REINFORCE_MIN, "reinforce").when(score <= WEAKEN_MAX, "weaken").otherwise("none")


def edge_updates(feedback: DataFrame) -> DataFrame:
    """Weight steps from scored feedback: ``(link, a, b, action, delta, ts, feedback_id)``.

    ``feedback(feedback_id, ts, overall_score, confidence, chunk_ids, concept_ids)``. Good
    scores raise concept pairs and chunk-concept links, bad ones lower the latter. Pairs
    are formed inside one feedback row's short concept list.
    """
    score = F.col("overall_score")
    acted = feedback.withColumn("action", feedback_band(score)).where(F.col("action") != "none").withColumn(
        "delta",
        F.when(F.col("action") == "reinforce", REINFORCE_STEP * score * F.col("confidence"))
        .otherwise(-WEAKEN_STEP * (1 - score) * F.col("confidence")),
    )
    concept_pairs = F.flatten(F.transform(
        "concept_ids",
        lambda x, i: F.transform(
            F.slice(F.col("concept_ids"), i + 2, F.size("concept_ids")),
            lambda y: F.struct(F.lit("concept").alias("link"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")),
        ),
    ))
    support = F.flatten(F.transform(
        "chunk_ids",
        lambda c: F.transform(
            F.col("concept_ids"), lambda x: F.struct(F.lit("evidence").alias("link"), x.alias("a"), c.alias("b"))
        ),
    ))
    links = F.when(F.col("action") == "reinforce", F.concat(concept_pairs, support)).otherwise(support)
    return unfold(acted, ["feedback_id", "ts", "action", "delta"], links, "l").select(
        "l.link", "l.a", "l.b", "action", "delta", "ts", "feedback_id"
    )


def _compose(steps: Column) -> Column:
    """One clamped shift equal to applying the listed ones in order.

    A step maps w to min(hi, max(lo, w + shift)); such maps compose into one of the same
    kind, so a long history can be folded in pieces.
    """
    first = F.struct(
        F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("weakened")
    )
    clamp = lambda x, s: F.least(s["hi"], F.greatest(s["lo"], x))
    return F.aggregate(
        steps, first,
        lambda acc, s: F.struct(
            (acc["shift"] + s["shift"]).alias("shift"),
            clamp(acc["lo"] + s["shift"], s).alias("lo"),
            clamp(acc["hi"] + s["shift"], s).alias("hi"),
            (acc["weakened"] + s["weakened"]).alias("weakened"),
        ),
    )


LINK = ["link", "a", "b"]


def _folded(level: DataFrame, order: list[str], span: Column | None, block: int | None = None) -> DataFrame:
    """Steps of each link (and span) composed in order; with ``block`` at most so many rows in one list."""
    keys = [*LINK, *([span.alias("_span")] if span is not None else [])]
    names = [*LINK, *(["_span"] if span is not None else [])]
    if block:
        place = Window.partitionBy(*names).orderBy(*order)
        level = level.withColumns({"_span": span} if span is not None else {}).withColumn(
            "_block", F.floor((F.row_number().over(place) - 1) / block)
        )
        keys = names = [*names, "_block"]
    return level.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, "shift", "lo", "hi", "weakened"))).alias("steps"),
        F.max("last_reinforced").alias("last_reinforced"), F.max("last_weakened").alias("last_weakened"),
    ).withColumn("m", _compose(F.col("steps"))).select(
        *names, *[F.col("m")[c].alias(c) for c in ("shift", "lo", "hi", "weakened")], "last_reinforced", "last_weakened"
    )


def fold_updates(updates: DataFrame, spans: tuple[str, ...] = ("MINUTE", "DAY"), block: int = 1000) -> DataFrame:
    """Fold steps per link in arrival order: inside short time spans, then over longer ones.

    Each level lists what one link did in one span and replaces it by a single step. Steps of one minute are listed in
    blocks of at most ``block``, so even a link named by very many rows at one time never has them all in one list.
    """
    up = F.col("action") == "reinforce"
    level = updates.select(
        *LINK, "ts", "feedback_id", "delta", F.col("delta").alias("shift"),
        F.when(up, F.lit(float("-inf"))).otherwise(F.lit(WEIGHT_FLOOR)).alias("lo"),
        F.when(up, F.lit(WEIGHT_CAP)).otherwise(F.lit(float("inf"))).alias("hi"),
        F.when(up, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("weakened"),
        F.when(up, F.col("ts")).alias("last_reinforced"), F.when(~up, F.col("ts")).alias("last_weakened"),
    )
    level = _folded(level, ["ts", "feedback_id", "delta"], F.date_trunc(spans[0], "ts"), block)
    level = _folded(level.withColumnRenamed("_span", "ts"), ["_block"], F.col("ts"))
    for span in (*spans[1:], None):
        level = level.withColumnRenamed("_span", "ts")
        level = _folded(level, ["ts"], F.date_trunc(span, "ts") if span else None)
    return level


def merge_folded(parts: DataFrame, order: str = "batch") -> DataFrame:
    """One step per link from the folded steps of several batches that follow each other by ``order``."""
    return _folded(parts, [order], None)


def apply_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Edges with every update applied in arrival order; links without an edge are ignored."""
    return apply_folded(edges, cut_lineage(fold_updates(updates), "folded"))


def apply_folded(edges: DataFrame, folded: DataFrame) -> DataFrame:
    """Edges after one folded step per link."""
    link = F.when(F.col("edge_type") == EVIDENCE, "evidence").otherwise("concept")
    is_evidence = F.col("edge_type") == EVIDENCE
    keyed = edges.withColumn("link", link).withColumn(
        "a", F.when(is_evidence, F.col("src")).otherwise(F.least("src", "dst"))
    ).withColumn("b", F.when(is_evidence, F.col("dst")).otherwise(F.greatest("src", "dst")))
    moved = F.least(F.col("hi"), F.greatest(F.col("lo"), F.coalesce("weight", F.lit(MISSING_WEIGHT)) + F.col("shift")))
    return (
        keyed.join(folded, ["link", "a", "b"], "left")
        .withColumn("weight", F.when(F.col("shift").isNotNull(), moved).otherwise(F.col("weight")))
        .withColumn("negative_signals", (F.col("negative_signals") + F.coalesce("weakened", F.lit(0))).cast("int"))
        .select(*edges.columns, "last_reinforced", "last_weakened")
    )


def reinforce(feedback: DataFrame, edges: DataFrame) -> DataFrame:
    return apply_updates(edges, edge_updates(feedback).where(F.col("action") == "reinforce"))


def weaken(feedback: DataFrame, edges: DataFrame) -> DataFrame:
    return apply_updates(edges, edge_updates(feedback).where(F.col("action") == "weaken"))


def review_marks(feedback: DataFrame) -> DataFrame:
    """Chunks of very bad feedback with the reason of the latest one."""
    bad = feedback.where(F.col("overall_score") < REVIEW_BELOW)
    return bad.select(F.explode("chunk_ids").alias("chunk_id"), "ts", "feedback_id", "overall_score").groupBy("chunk_id").agg(
        F.lit(True).alias("needs_review"),
        F.concat(F.lit("low_feedback_score_"), two_decimals(F.max_by("overall_score", F.struct("ts", "feedback_id")))).alias("review_reason"),
        F.max("ts").alias("marked_for_review_at"),
    )


def revector_tasks(feedback: DataFrame) -> DataFrame:
    """Re-embedding tasks for the worst feedback that names chunks."""
    return feedback.where((F.col("overall_score") <= REEMBED_MAX) & (F.size("chunk_ids") > 0)).select(
        F.col("feedback_id").alias("task_id"), "chunk_ids",
        F.concat(F.lit("low_score_"), two_decimals("overall_score")).alias("reason"),
        F.lit(REEMBED_PRIORITY).alias("priority"), F.col("ts").alias("scheduled_at"), F.lit("pending").alias("status"),
    )


def apply_feedback(feedback: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Updated edges, review marks, re-embedding tasks and a per-feedback summary."""
    n_chunks, n_concepts = F.size("chunk_ids"), F.size("concept_ids")
    band = feedback_band(F.col("overall_score"))
    summary = feedback.select(
        "feedback_id", band.alias("action"),
        F.when(band == "reinforce", n_concepts * (n_concepts - 1) / 2 + n_chunks * n_concepts).otherwise(0).cast("int").alias("edges_reinforced"),
        F.when(band == "weaken", n_chunks * n_concepts).otherwise(0).cast("int").alias("edges_weakened"),
        ((F.col("overall_score") <= REEMBED_MAX) & (n_chunks > 0)).alias("revectorization_scheduled"),
    )
    return {
        "edges": apply_updates(edges, edge_updates(feedback)),
        "review": review_marks(feedback),
        "tasks": revector_tasks(feedback),
        "summary": summary,
    }


def revector_queue(tasks: DataFrame, chunks: DataFrame, max_tasks: int = 5) -> DataFrame:
    """Chunks of the next pending tasks, best (lowest) priority first, with their content."""
    picked = tasks.where(F.col("status") == "pending").orderBy("priority", "scheduled_at", "task_id").limit(max_tasks)
    return picked.select("task_id", "priority", F.explode("chunk_ids").alias("chunk_id")).join(chunks, "chunk_id").where(
        F.length("content") > 0
    )


def finish_tasks(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Task table with the status of processed tasks; ``outcomes(task_id, ok)``."""
    done = outcomes.groupBy("task_id").agg(F.min("ok").alias("_ok"))
    status = F.when(F.col("_ok"), "completed").when(~F.col("_ok"), "failed").otherwise(F.col("status"))
    return tasks.join(done, "task_id", "left").withColumn("status", status).select(*tasks.columns)


def pending_summary(updates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts of waiting edge updates and re-embedding tasks, one row."""
    waiting = updates.where(~F.col("applied")).select(F.lit(1).alias("u"), F.lit(0).alias("t"))
    queued = tasks.where(F.col("status") == "pending").select(F.lit(0).alias("u"), F.lit(1).alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return waiting.unionByName(queued).agg(
        total("u").alias("pending_edge_updates"), total("t").alias("pending_revectorizations"),
        (total("u") + total("t")).alias("total_pending"),
    )


def weak_edges(edges: DataFrame, threshold: float = 0.3, min_signals: int = 5, limit: int = 50) -> DataFrame:
    return (
        edges.where((F.col("weight") < threshold) & (F.col("negative_signals") >= min_signals))
        .orderBy("weight", "edge_type", "src", "dst").limit(limit)
    )


def strong_edges(edges: DataFrame, threshold: float = 0.8, limit: int = 50) -> DataFrame:
    return edges.where(F.col("weight") >= threshold).orderBy(F.col("weight").desc(), "edge_type", "src", "dst").limit(limit)


def apply_pending(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """Apply the updates not applied yet, in arrival order."""
    return apply_updates(edges, updates.where(~F.col("applied")).drop("applied"))
