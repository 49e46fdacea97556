"""Documents to sources, chunks and edges; embeddings for chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarrymind.functions import text as tx
from quarrymind.operators import chunking as ch
from quarrymind.operators import documents as dm
from quarrymind.session import cut_lineage, small_side

MAX_ATTEMPTS = 3
Embedder = Callable[[list[str]], list[list[float]]]


class Ingested(NamedTuple):
    sources: DataFrame
    chunks: DataFrame
    edges: DataFrame
    rejects: DataFrame


def ingest(
    docs: DataFrame, key: str = "source_id", content: str = "content", path: str | None = None, url: str | None = None,
    size: int = ch.CHUNK_SIZE, overlap: int = ch.CHUNK_OVERLAP, min_words: int = 10, as_of: str | None = None,
) -> Ingested:
    """Process, validate and chunk documents; rejected rows keep their reason.

    Texts are processed and chunked once, into a staged table that all four results read.
    """
    processed = dm.validate_docs(dm.process_documents(docs, content, path, url), min_words=min_words)
    chunks = F.when(F.col("valid"), ch.hierarchy_of("normalized", size, overlap=overlap))
    named = lambda c, alias: (F.col(c) if c else F.lit(None).cast("string")).alias(alias)
    staged = cut_lineage(
        processed.select(
            F.col(key).alias("source_id"), "title", "content_type", "word_count", named(url, "url"), named(path, "file_path"),
            (F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()).alias("created_at"), "valid", "error",
            chunks.alias("chunks"),
        ),
        "ingest",
    )
    good = staged.where("valid")
    sources = good.select(
        "source_id", "title", "content_type", "url", "file_path", "word_count", F.size("chunks").alias("total_chunks"), "created_at"
    )
    pieces = ch.explode_hierarchy(good, "source_id")
    rejects = staged.where(~F.col("valid")).select("source_id", "title", "content_type", "error")
    return Ingested(sources, pieces, ch.chunk_edges(pieces), rejects)


def reprocess(docs: DataFrame, ids: DataFrame, key: str = "source_id", **options) -> Ingested:
    """Ingest again the documents whose id is in ``ids``."""
    return ingest(docs.join(small_side(ids.select(key).distinct()), key, "left_semi"), key, **options)


def write_ingested(result: Ingested, base: str, version: int | None = None) -> int:
    """Store the results as one version; a source that is stored already is replaced by it, with its chunks and edges.

    Every version has its own folders, so storing it again changes nothing, and it counts only once its list of sources, written
    last, is there. Without a number the next free one is taken. Edges are laid out by type and carry the source they come from.
    """
    spark = result.sources.sparkSession
    if version is None:
        stored = _stored(spark, base, "versions")
        version = 0 if stored is None else stored.agg(F.max("version")).first()[0] + 1
    owner = result.chunks.select(F.col("chunk_id").alias("src"), "source_id")
    parts = result._asdict() | {"edges": result.edges.join(owner, "src")}
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("edge_type") if name == "edges" else writer).parquet(f"{base}/{name}/version={version}")
    came = result.sources.select("source_id").unionByName(result.rejects.select("source_id")).distinct()
    came.write.mode("overwrite").parquet(f"{base}/versions/version={version}")
    return version


def _stored(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{base}/{name}")
    except AnalysisException:  # nothing is stored yet
        return None


def read_ingested(spark: SparkSession, base: str) -> Ingested:
    """The stored tables, each source as its newest version has it."""
    newest = spark.read.parquet(f"{base}/versions").groupBy("source_id").agg(F.max("version").alias("version"))
    tables = [spark.read.parquet(f"{base}/{name}").join(newest, ["source_id", "version"], "left_semi").drop("version") for name in Ingested._fields]
    return Ingested(*tables)


def embed_table(df: DataFrame, embedder: Embedder, dim: int, key: str, col: str = "content", batch_size: int = 50) -> DataFrame:
    """Add ``embedding`` from a user's function over batches of texts; blank texts get zeros.

    Returns ``(key, embedding)``. The function is sent to the tasks and must be importable there.
    """
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(col).to_pylist()
            vectors = [[0.0] * dim for _ in texts]
            asked = [i for i, t in enumerate(texts) if t and t.strip()]
            for start in range(0, len(asked), batch_size):
                part = asked[start:start + batch_size]
                for i, vec in zip(part, embedder([texts[j] for j in part])):
                    if len(vec) != dim:
                        raise ValueError(f"embedder gave {len(vec)} values, not {dim}")
                    vectors[i] = vec
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, col).mapInArrow(run, schema)


def embedding_progress(chunks: DataFrame, embeddings: DataFrame, attempts: DataFrame, group: str = "source_id") -> DataFrame:
    """Share of chunks embedded per group, with failed ones that may or may not be tried again.

    ``attempts(chunk_id, attempts)`` counts failures.
    """
    done = embeddings.select("chunk_id").distinct().withColumn("_done", F.lit(True))
    joined = chunks.join(done, "chunk_id", "left").join(attempts.groupBy("chunk_id").agg(F.max("attempts").alias("_a")), "chunk_id", "left")
    finished = F.coalesce(F.col("_done"), F.lit(False))
    failed = ~finished & F.col("_a").isNotNull()
    return joined.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(finished).alias("completed"),
        (F.count_if(finished) / F.count("*") * 100).alias("percentage"),
        F.count_if(failed & (F.col("_a") < MAX_ATTEMPTS)).alias("to_retry"),
        F.count_if(failed & (F.col("_a") >= MAX_ATTEMPTS)).alias("failed"),
    )


def embedding_backlog(chunks: DataFrame, embeddings: DataFrame, attempts: DataFrame) -> DataFrame:
    """Chunks without an embedding whose failures leave another attempt."""
    spent = attempts.where(F.col("attempts") >= MAX_ATTEMPTS).select("chunk_id").distinct()
    return chunks.join(embeddings.select("chunk_id").distinct(), "chunk_id", "left_anti").join(spent, "chunk_id", "left_anti")
