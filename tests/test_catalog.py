"""Registered queries against their SQL on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "keyword_fallback", "vector_topk", "fuse_weighted", "dedup_hits", "graph_expand", "graph_paths", "apply_feedback",
    "feedback_weighted", "chunk_ewma", "confusion", "mastery", "weaknesses", "retained_turns", "answer_reuse", "classify_mode",
    "bm25_pruned", "multi_field_search", "near_duplicates", "bpe_token_counts", "bpe_chunks", "bpe_truncate_sentences",
    "score_answers", "hierarchical_chunk", "html_to_text", "keywords", "resolve_entities", "hybrid_retrieve", "signals_stream",
]


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = entry_module.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(names, cursor.fetchall())
