"""Sentence-packed, overlapping and hierarchical chunks of document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymind.functions import text as tx
from quarrymind.functions.rows import unfold

CHUNK_SIZE = 512
CHUNK_OVERLAP = 50

_PAIRS = "array<struct<first:int,last:int>>"


def _pack(costs: Column, size: int, overlap: int) -> Column:
    """Sentence ranges [first, last) of the chunks, from the sentences' token costs.

    The fold carries indexes and the costs of the open chunk only, never text. A new chunk
    starts with the longest tail of the previous one that costs at most ``overlap``.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("first"),
        F.lit(0).alias("used"),
        F.array().cast("array<int>").alias("open"),
        F.array().cast(_PAIRS).alias("done"),
    )

    def tail(open_costs: Column) -> Column:
        init = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def back(acc: Column, cost: Column) -> Column:
            take = acc["go"] & (acc["used"] + cost <= overlap)
            return F.struct(
                (acc["used"] + F.when(take, cost).otherwise(0)).alias("used"),
                (acc["n"] + take.cast("int")).alias("n"),
                take.alias("go"),
            )

        return F.aggregate(F.reverse(open_costs), init, back)

    def step(acc: Column, cost: Column) -> Column:
        full = (acc["used"] + cost > size) & (F.size(acc["open"]) > 0)
        kept = F.when(full, tail(acc["open"])).otherwise(
            F.struct(acc["used"].alias("used"), F.size(acc["open"]).alias("n"), F.lit(True).alias("go"))
        )
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, acc["i"] - kept["n"]).otherwise(acc["first"]).alias("first"),
            (kept["used"] + cost).alias("used"),
            F.concat(
                F.slice(acc["open"], F.size(acc["open"]) - kept["n"] + 1, kept["n"]), F.array(cost)
            ).alias("open"),
            F.when(
                full,
                F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["i"].alias("last")))),
            ).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(
        costs,
        start,
        step,
        lambda acc: F.when(
            F.size(acc["open"]) > 0,
            F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["i"].alias("last")))),
        ).otherwise(acc["done"]),
    )


def chunk_texts(c: Column | str, size: int, overlap: int, tokens: tx.TokenEstimator = tx.estimate_tokens) -> Column:
    """Array of chunk texts of one text column."""
    text = F.col(c) if isinstance(c, str) else c
    # Bound, so that the text is split once and not once per use.
    return tx.bind(
        tx.sentences(F.coalesce(text, F.lit(""))), lambda parts: _joined(parts, F.transform(parts, tokens), size, overlap)
    )


def _joined(parts: Column, costs: Column, size: int, overlap: int) -> Column:
    return F.transform(
        _pack(costs, size, overlap), lambda r: F.array_join(F.slice(parts, r["first"] + 1, r["last"] - r["first"]), " ")
    )


def _with_chunk_texts(df: DataFrame, keep: list[str], col: str, size: int, overlap: int, tokens: tx.TokenEstimator) -> DataFrame:
    """``keep`` and ``texts``, the chunk texts of ``col``. Estimators that run in Python count a column of sentences, not inside of an expression."""
    if not hasattr(tokens, "each"):
        return df.select(*keep, chunk_texts(col, size, overlap, tokens).alias("texts"))
    split = df.select(*keep, tx.sentences(F.coalesce(F.col(col), F.lit(""))).alias("_parts"))
    counted = split.withColumn("_costs", tokens.each("_parts"))
    return counted.select(*keep, _joined(F.col("_parts"), F.col("_costs"), size, overlap).alias("texts"))


def chunk_overlapping(
    df: DataFrame, key: str = "doc_id", col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    tokens: tx.TokenEstimator = tx.estimate_tokens,
) -> DataFrame:
    """Chunks ``(key, chunk_index, content, token_count)``; a narrow job without shuffles."""
    texts = _with_chunk_texts(df, [key], col, size, overlap, tokens)
    return unfold(texts, [key], "texts", "content", "chunk_index").withColumn("token_count", tokens(F.col("content")))


def _offsets(overlap: int) -> Callable[[Column], Column]:
    """Start offsets of an array of chunk texts: each moves on by its length less the overlap."""
    return lambda texts: F.aggregate(
        texts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) - overlap * 4).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def simple_chunk(
    df: DataFrame, key: str = "doc_id", col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    tokens: tx.TokenEstimator = tx.estimate_tokens,
) -> DataFrame:
    """Flat chunks with approximate offsets (they assume ``overlap`` tokens of four characters)."""
    rows = tx.bind(
        F.col("texts"),
        lambda texts: F.zip_with(
            texts, _offsets(overlap)(texts), lambda t, s: F.struct(t.alias("content"), s.alias("approx_start"))
        ),
    )
    return (
        unfold(_with_chunk_texts(df, [key], col, size, overlap, tokens), [key], rows, "r", "chunk_index")
        .select(
            key, "chunk_index", F.lit(0).alias("level"), "r.content",
            tokens(F.col("r.content")).alias("token_count"),
            "r.approx_start",
            (F.col("r.approx_start") + F.length("r.content")).alias("approx_end"),
        )
    )


def hierarchy_of(
    col: Column | str, size: int = CHUNK_SIZE, parent_size: int | None = None, overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = ("\n\n\n",),
) -> Column:
    """Array of chunk structs of one text: a parent per large section, then its children.

    Built inside the row: the section list becomes a list of chunks, and positions in that
    list are the document-wide index.
    """
    parent_chars = (parent_size or size * 2) * 4
    text = F.col(col) if isinstance(col, str) else col

    def leaf(content: Column, level: int, section: Column, child: Column, start: Column, length: Column) -> Column:
        return F.struct(
            tx.strip(content).alias("content"), F.lit(level).alias("level"),
            section.alias("section"), child.cast("int").alias("child"),
            start.cast("int").alias("approx_start"), (start + length).cast("int").alias("approx_end"),
        )

    def expand(section: Column, index: Column, start: Column) -> Column:
        """Chunks of one section, whose first character is at ``start``."""
        children = tx.bind(
            chunk_texts(section, size, overlap),
            lambda texts: F.zip_with(
                F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                _offsets(overlap)(texts),
                lambda c, s: leaf(c["t"], 1, index, c["i"], start + s, F.length(c["t"])),
            ),
        )
        parent = F.substring(section, 1, parent_chars)
        return F.when(
            tx.estimate_tokens(section) <= size,
            F.array(leaf(section, 1, index, F.lit(-2), start, F.length(section))),
        ).otherwise(
            F.concat(F.array(leaf(parent, 0, index, F.lit(-1), start, F.length(parent))), children)
        )

    placed = F.aggregate(
        tx.split_by(text, list(separators)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<section:string,at:int>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(s.alias("section"), acc["at"].alias("at")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(placed, lambda p, i: expand(p["section"], i, p["at"])))


def explode_hierarchy(df: DataFrame, key: str, chunks: str = "chunks") -> DataFrame:
    """Chunk rows from a column made by :func:`hierarchy_of`, with ids derived from their place."""
    node = lambda child: F.substring(
        F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("c.section").cast("string"), child.cast("string")), 256), 1, 16
    )
    return unfold(df, [key], chunks, "c", "chunk_index").select(
        node(F.col("c.child")).alias("chunk_id"),
        F.col(key).alias("source_id"),
        "chunk_index",
        F.when(F.col("c.child") >= 0, node(F.lit(-1))).alias("parent_chunk_id"),
        "c.level", "c.content",
        tx.estimate_tokens("c.content").alias("token_count"),
        "c.approx_start", "c.approx_end",
    )


def hierarchical_chunk(
    df: DataFrame, key: str = "doc_id", col: str = "text", size: int = CHUNK_SIZE, parent_size: int | None = None,
    overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = ("\n\n\n",),
) -> DataFrame:
    """Parent chunks per large section with overlapping children; small sections stand alone. No shuffle."""
    held = df.where(F.length(tx.strip(col)) > 0)
    return explode_hierarchy(held.select(key, hierarchy_of(col, size, parent_size, overlap, separators).alias("chunks")), key)


def merge_small(parts: Column | str, min_tokens: int = 50, tokens: tx.TokenEstimator = tx.estimate_tokens) -> Column:
    """Join array elements to the next until each has ``min_tokens``; the last may stay small."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    init = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        empty = F.length(acc["open"]) == 0
        grow = tokens(acc["open"]) < min_tokens
        return F.struct(
            F.when(empty | ~grow, part).otherwise(F.concat_ws(" ", acc["open"], part)).alias("open"),
            F.when(empty | grow, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
        )

    return F.aggregate(
        parts, init, step,
        lambda acc: F.when(F.length(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )


def chunk_links(chunks: DataFrame) -> DataFrame:
    """Parent to children, in index order. A parent's children are the pieces of one section."""
    return (
        chunks.where(F.col("parent_chunk_id").isNotNull())
        .groupBy(F.col("parent_chunk_id").alias("chunk_id"))
        .agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c"))
        .select("chunk_id", F.col("c.chunk_id").alias("children_ids"))
    )


def chunk_tree(chunks: DataFrame) -> DataFrame:
    """One row per root chunk with the list of its children (id, index, tokens)."""
    children = (
        chunks.where(F.col("parent_chunk_id").isNotNull())
        .groupBy(F.col("parent_chunk_id").alias("chunk_id"))
        .agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.col("chunk_id").alias("id"), "token_count"))).alias("children"))
    )
    roots = chunks.where(F.col("parent_chunk_id").isNull() & (F.col("level") == 0))
    return roots.select("source_id", "chunk_id", "chunk_index", "token_count").join(children, "chunk_id", "left")


def chunk_hierarchy(chunks: DataFrame) -> DataFrame:
    """Totals per source: all chunks, parents (level 0), children, roots."""
    return chunks.groupBy("source_id").agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("level") == 0).alias("parent_count"),
        F.count_if(F.col("level") > 0).alias("child_count"),
        F.count_if((F.col("level") == 0) & F.col("parent_chunk_id").isNull()).alias("root_count"),
    )


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """Edges chunk -> source and parent -> child, both with full weight."""
    full = [F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence")]
    belongs = chunks.select(
        F.lit("belongs_to").alias("edge_type"), F.col("chunk_id").alias("src"),
        F.col("source_id").cast("string").alias("dst"), *full,
    )
    parent = chunks.where(F.col("parent_chunk_id").isNotNull()).select(
        F.lit("parent_of").alias("edge_type"), F.col("parent_chunk_id").alias("src"), F.col("chunk_id").alias("dst"), *full
    )
    return belongs.unionByName(parent)


def validate_chunks(chunks: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """One row per problem: empty, under 10 tokens, over three sizes, parent on a level-0 chunk."""
    empty = F.coalesce(F.length(tx.strip("content")), F.lit(0)) == 0
    n = F.col("token_count")
    problems = F.when(empty, F.array(F.lit("empty"))).otherwise(
        F.array_compact(F.array(
            F.when(n < 10, F.lit("too_short")),
            F.when(n > chunk_size * 3, F.lit("too_long")),
            F.when(F.col("parent_chunk_id").isNotNull() & (F.col("level") == 0), F.lit("parent_on_level_0")),
        ))
    )
    return chunks.select("chunk_id", "source_id", "token_count", F.explode(problems).alias("problem"))
