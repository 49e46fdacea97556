"""From raw documents to training text: five stages, each written as Parquet and read back as the next one's input.

All stages but the last return the columns of ``documents``. Filters drop whole rows and change nothing else; private spans are replaced in
the text (and ``n_chars`` follows); the last stage adds token ids and the text that they decode to. Null texts pass as empty ones;
an empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymind.llm import pieces, private, quality, simhash, tiling
from quarrymind.llm.common import cut_lineage, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker rejects go. It is fitted on labelled rows of the given documents that are not held out."""
    ranker = quality.fit(docs, read_table(spark, sf_dir, "labels").where(~quality.held_out()), quality.THRESHOLD)
    return quality.keep_good(docs, ranker)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order of its passages, go."""
    return tiling.drop_leaked(docs, read_table(spark, sf_dir, "benchmark"))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind."""
    return private.redact(docs, private.train(private.labelled_lines()))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text decoded from them."""
    import public_tokenizers

    return pieces.add_ids(docs, pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("benchmark", benchmark_stage),
    ("private", private_stage), ("tokens", token_stage),
]
#: Fitted models, components and Viterbi have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
