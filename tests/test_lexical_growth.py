"""What a task of a search and a block of the index hold stays bounded as the documents grow."""

import random

from pyspark.sql import functions as F

from quarrymind.operators import lexical


def corpus(spark, n):
    draw = random.Random(n)
    docs = [(i, " ".join(["often", *(f"w{draw.randint(0, 50)}" for _ in range(draw.choice([8, 9, 30, 31])))])) for i in range(n)]
    queries = [(q, f"often w{q}") for q in range(20)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, text string")


def test_blocks_hold_as_many_documents_as_stated(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    docs, _ = corpus(spark, 1000)
    index = lexical.build_index(docs)
    blocks = index.postings.where("term = 'often'").groupBy("block").agg(F.count("*").alias("n")).agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    assert blocks.n == 1000 and blocks.blocks <= 30


def test_tasks_score_as_many_pairs_however_postings_are_stored(spark, monkeypatch):
    """All postings of a bucket lie in one file here, and one term is in all documents and queries."""
    docs, queries = corpus(spark, 1000)
    index = lexical.build_index(docs)
    plain = sorted(map(tuple, lexical.bm25_search(index, queries, 5, prune=False).collect()))
    monkeypatch.setattr(lexical, "TASK_PAIRS", 2000)
    search = lexical._prepare(index, queries, "query_id", "text")
    pairs = search.wanted.agg(F.sum("df")).first()[0]
    dealt = lexical._dealt(search, search.wanted, pairs, "doc_id").join(search.wanted, ["bucket", "term"])
    held = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert pairs > 20000 and sum(held) == pairs and max(held) < 5000
    assert sorted(map(tuple, lexical.bm25_search(index, queries, 5, prune=False).collect())) == plain
    assert sorted(map(tuple, lexical.bm25_search(index, queries, 5, prune=True).collect())) == plain
