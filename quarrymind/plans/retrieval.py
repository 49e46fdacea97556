"""Whole retrieval plans: a table of queries against the lexical, vector and graph sources."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from quarrymind.functions import text as tx
from quarrymind.operators import fusion, graph, hits as ht, lexical, vector
from quarrymind.session import cut_lineage

MODES = ("vector_only", "bm25_only", "graph_only", "hybrid", "adaptive")


class Corpus(NamedTuple):
    """What is searched. Ids are record ids such as ``chunk:12`` and ``concept:7``.

    ``chunks(chunk_id, content, metadata)``, ``vectors(chunk_id, embedding)``,
    ``nodes(node_id, node_type, name, description)`` and ``edges``.
    """

    index: lexical.LexicalIndex
    vectors: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame


_HIT = ["query_id", "source", "rank", "doc_id", "score"]


def vector_hits(queries: DataFrame, corpus: Corpus, k: int, min_score: float = 0.0) -> DataFrame:
    found = vector.vector_search(corpus.vectors, queries, k, min_score, key="chunk_id")
    return found.withColumn("source", F.lit("vector")).select(*_HIT)


def bm25_hits(queries: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    cleaned = queries.select("query_id", tx.clean_query("text").alias("text")).where(F.length("text") > 0)
    return lexical.bm25_search(corpus.index, cleaned, k).withColumn("source", F.lit("bm25")).select(*_HIT)


def graph_hits(seeds: DataFrame, corpus: Corpus, max_nodes: int = 20) -> DataFrame:
    """Hits around the seeds: supporting chunks by relevance, then described nodes by score."""
    reached = graph.expand(seeds, corpus.edges, 2, max_nodes)
    found = graph.graph_hits(reached, corpus.edges, corpus.nodes, corpus.chunks)
    order = Window.partitionBy("query_id").orderBy("kind", F.col("score").desc(), "item_id")
    return found.select(
        "query_id", F.lit("graph").alias("source"), F.row_number().over(order).alias("rank"), F.col("item_id").alias("doc_id"), "score"
    )


def _seeds(queries: DataFrame, corpus: Corpus, limit: int = 3) -> DataFrame:
    """Given concepts where a query has any, else those whose name or description holds its text."""
    found = lexical.find_by_substring(corpus.nodes, queries, "node_id", ["name", "description"], limit)
    if "concepts" not in queries.columns:
        return found.select("query_id", "node_id")
    given = queries.select("query_id", F.explode("concepts").alias("node_id"))
    bare = queries.where(F.coalesce(F.size("concepts"), F.lit(0)) <= 0).select("query_id")
    return given.unionByName(found.join(bare, "query_id", "left_semi").select("query_id", "node_id"))


def contents(corpus: Corpus) -> DataFrame:
    """Text of everything that can be a hit."""
    described = corpus.nodes.where(F.length("description") > 0)
    return corpus.chunks.select(F.col("chunk_id").alias("doc_id"), "content").unionByName(
        described.select(F.col("node_id").alias("doc_id"), F.col("description").alias("content"))
    )


def _found(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The stored rows of ``texts`` that are hits. An inner join, so the few ids are sent to the texts and the corpus stays
    in place; the result is small."""
    ids = cut_lineage(hits.select("doc_id").distinct(), "hit-ids")
    return cut_lineage(texts.join(ids, "doc_id"), "hit-texts")


def _with_content(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """Hits with their text; one whose text is not stored keeps its place with an empty one."""
    texts = _found(hits, contents(corpus))
    return hits.join(texts, "doc_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def hybrid_retrieve(
    queries: DataFrame, corpus: Corpus, mode: str = "hybrid", k: int = 10, weights: dict[str, float] | None = None,
    method: str = "weighted",
) -> DataFrame:
    """Top ``k`` per query: ``(query_id, doc_id, final_score, …, content, rank)``.

    Each source gives twice ``k`` hits. Several sources are fused, three times ``k``
    results are compared by content, and near-copies are dropped before the final cut.
    """
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    parts = []
    if mode in ("vector_only", "hybrid", "adaptive"):
        parts.append(vector_hits(queries, corpus, k * 2))
    if mode in ("bm25_only", "hybrid", "adaptive"):
        parts.append(bm25_hits(queries, corpus, k * 2))
    if mode in ("graph_only", "hybrid", "adaptive"):
        parts.append(graph_hits(_seeds(queries, corpus), corpus))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    # The few hits per query are read several times below; the searches run once. Stored
    # hits also have a known size, so texts are joined without moving the corpus.
    hits = cut_lineage(hits, "hits")
    if len(parts) == 1:
        own = hits.where(F.col("rank") <= k).withColumnRenamed("score", "final_score")
        return _with_content(own, corpus)
    if mode == "adaptive":
        hits = hits.join(fusion.adapt_weights(hits, weights), "query_id")
    fused = cut_lineage(fusion.fuse(hits, method, weights, max_results=k * 3), "fused")
    return fusion.dedup_hits(_with_content(fused, corpus)).where(F.col("rank") <= k)


def quick_search(queries: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
    return hybrid_retrieve(queries, corpus, "hybrid", k)


def semantic_search(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    return hybrid_retrieve(queries, corpus, "vector_only", k)


def keyword_search(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    return hybrid_retrieve(queries, corpus, "bm25_only", k)


def concept_search(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    return hybrid_retrieve(queries, corpus, "graph_only", k)


def context_for(queries: DataFrame, corpus: Corpus, max_tokens: int = 8000, mode: str = "hybrid") -> DataFrame:
    """Context text per query within a token budget, assuming about 500 tokens a chunk."""
    return fusion.build_context(hybrid_retrieve(queries, corpus, mode, max(max_tokens // 500, 3)), max_tokens)


def retrieve_with_strategy(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Hits for queries that carry retrieval settings (see ``routing.strategy_for``).

    Vector hits must reach 0.8 of the minimum score; both text sources pass the type
    preference; graph-enhanced queries also start a walk from the concepts found. Sources
    are fused with the query's own weights, near-copies dropped, and ``top_k`` kept.
    Metadata-only queries get exercise listings instead.
    """
    max_k = queries.agg(F.max("top_k")).first()[0] or 1
    settings = queries.select(
        "query_id", "top_k", "min_score", "chunk_type_filter", "strategy", "expand_concepts",
        "vector_weight", "bm25_weight", "graph_weight",
    )
    listing = F.col("strategy") == "metadata_only"
    needed = F.when(listing, F.col("min_score")).otherwise(F.col("min_score") * 0.8)
    described = corpus.chunks.select(F.col("chunk_id").alias("doc_id"), "content", "metadata")
    text_hits = cut_lineage((
        vector_hits(queries, corpus, max_k * 2)
        .unionByName(bm25_hits(queries, corpus, max_k * 2))
        .join(settings, "query_id")
        .where(F.col("rank") <= F.col("top_k") * 2)
        .where((F.col("source") != "vector") | (F.col("score") >= needed))
        .where(~listing | (F.col("source") == "vector"))
    ), "hits")
    kept = ht.filter_chunk_type(ht.to_hits(text_hits.join(_found(text_hits, described), "doc_id", "left")), F.col("chunk_type_filter"), listing, ["query_id", "source"])
    place = Window.partitionBy("query_id").orderBy(F.col("source").desc(), "rank")
    positioned = kept.withColumn("position", F.row_number().over(place))
    enhanced = (F.col("strategy") == "graph_enhanced") & F.col("expand_concepts")
    found = lexical.find_by_substring(corpus.nodes, queries.where(enhanced), "node_id", ["name", "description"], 5)
    seeds = ht.seed_concepts(positioned.where(enhanced).select("query_id", "position", "concepts"), found)
    walked = graph.expand(seeds.select("query_id", "node_id"), corpus.edges, 2, max_k).join(settings.select("query_id", "top_k"), "query_id")
    near = walked.where(F.col("rank") <= F.greatest("top_k", F.lit(10))).drop("top_k")
    around = graph.graph_hits(near, corpus.edges, corpus.nodes, corpus.chunks)
    order = Window.partitionBy("query_id").orderBy("kind", F.col("score").desc(), "item_id")
    around = around.select(
        "query_id", F.lit("graph").alias("source"), F.row_number().over(order).alias("rank"), F.col("item_id").alias("doc_id"), "score"
    )
    weights = settings.select("query_id", "top_k", "vector_weight", "bm25_weight", "graph_weight")
    pool = cut_lineage(kept.where(~listing).select(*_HIT).unionByName(around), "hits").join(weights, "query_id")
    fused = fusion.fuse(pool, max_results=max_k * 3).join(weights.select("query_id", "top_k"), "query_id").where(
        F.col("rank") <= F.col("top_k") * 3
    )
    best = fusion.dedup_hits(_with_content(cut_lineage(fused, "fused"), corpus)).where(F.col("rank") <= F.col("top_k"))
    listed = ht.exercise_listing(kept.where(listing).drop("rank"), F.col("top_k"))
    shared = ["query_id", "doc_id", "rank", "final_score", "content", "exercise_title", "difficulty"]
    return best.withColumns({"exercise_title": F.lit(None).cast("string"), "difficulty": F.lit(None).cast("string")}).select(*shared).unionByName(
        listed.withColumnRenamed("score", "final_score").select(*shared)
    )


def retrieval_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count("*").alias("total_found"), F.max("final_score").alias("top_score"), F.avg("final_score").alias("avg_score")
    )
