"""The lexical index: pruned search, repeated and broken additions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymind.operators import lexical


def plain_search(docs, queries, top):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    mean, df = sum(map(len, words.values())) / len(words), Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scores = Counter()
        for term in set(re.findall(r"\w+", text.lower())):
            idf = math.log1p((len(words) - df[term] + 0.5) / (df[term] + 0.5))
            for i, ws in words.items():
                if tf := ws.count(term):
                    scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        ranked = sorted(((-round(s, 9), i) for i, s in scores.items()))[:top]
        out += [(q, i, round(-s, 6), n) for n, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.choice([0, 1, 3, 20, 60, 200])))) for i in range(600)] + [(601, None), (602, "only here once")]
    queries = [(q, " ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 2, 6, 12])))) for q in range(20)] + [(90, "once w0"), (91, "nowhere"), (92, "")]
    return docs, queries


def rows(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in df.collect())


def tables(spark, corpus):
    docs, queries = corpus
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("prune", [False, True])
def test_search_equals_plain_scoring(spark, corpus, prune, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    docs, queries = tables(spark, corpus)
    found = lexical.bm25_search(lexical.build_index(docs), queries, 5, prune=prune)
    assert rows(found) == plain_search(*corpus, 5)


def test_pruning_skips_blocks_and_postings(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST_POSTINGS", 8)
    docs, queries = tables(spark, corpus)
    index = lexical.build_index(docs)
    report = lexical.search_report(index, queries, 3).agg(*[F.sum(c).alias(c) for c in ("blocks", "skipped_blocks", "postings", "scored_postings")]).first()
    assert 0 < report.skipped_blocks < report.blocks and report.scored_postings < 0.8 * report.postings
    assert rows(lexical.bm25_search(index, queries, 3, prune=True)) == plain_search(*corpus, 3)


def test_repeated_and_broken_additions(spark, corpus, tmp_path):
    docs, queries = tables(spark, corpus)
    folder, want = str(tmp_path / "index"), plain_search(*corpus, 5)
    low, high = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0")
    for part in (low, high, low, high.repartition(2)):
        lexical.add_to_index(part, folder)
    # Postings without statistics are an addition that did not end: nobody reads them until it is done again.
    broken = spark.createDataFrame([(5000, "w0 w1 w2")], "doc_id long, text string")
    name = lexical.addition_name(broken, "doc_id", "text")
    lexical._postings(broken, "doc_id", "text", name).write.partitionBy("bucket").parquet(f"{folder}/postings/addition={name}")
    index = lexical.load_index(spark, folder)
    assert index.stats.count() == 2 and index.totals.first().n_docs == len(corpus[0])
    assert rows(lexical.bm25_search(index, queries, 5)) == rows(lexical.bm25_search(index, queries, 5, prune=True)) == want
    lexical.add_to_index(broken, folder)
    grown = lexical.load_index(spark, folder)
    assert grown.totals.first().n_docs == len(corpus[0]) + 1
    assert rows(lexical.bm25_search(grown, queries, 5, prune=True)) == plain_search([*corpus[0], (5000, "w0 w1 w2")], corpus[1], 5)


def test_all_terms_from_the_rarest_one(spark, corpus):
    """Every term of the query is asked for; the frequent ones are looked up for the documents of the rarest one only."""
    docs, queries = tables(spark, corpus)
    index = lexical.build_index(docs)
    want, words = [], {i: set(re.findall(r"\w+", (t or "").lower())) for i, t in corpus[0]}
    for q, text in corpus[1]:
        asked = set(re.findall(r"\w+", text.lower()))
        whole = [h for h in plain_search(corpus[0], [(q, text)], len(words)) if asked <= words[h[1]]]
        want += [(q, i, score, n) for n, (_, i, score, _) in enumerate(sorted(whole, key=lambda h: h[3])[:5], 1)]
    assert rows(lexical.bm25_search(index, queries, 5, match="all")) == sorted(want) and len(want) > 20
    search = lexical._prepare(index, queries, "query_id", "text")
    rarest = search.wanted.groupBy("query_id").agg(F.min("df").alias("df")).agg(F.sum("df")).first()[0]
    assert lexical._all_terms(search).count() <= rarest


def test_large_searches_are_pruned_unasked(spark, corpus, monkeypatch):
    docs, queries = tables(spark, corpus)
    index, pruned = lexical.build_index(docs), []
    inner = lexical._near
    monkeypatch.setattr(lexical, "_near", lambda search, top: pruned.append(top) or inner(search, top))
    assert rows(lexical.bm25_search(index, queries, 5)) == plain_search(*corpus, 5) and not pruned
    monkeypatch.setattr(lexical, "PRUNE_FROM", 100)
    assert rows(lexical.bm25_search(index, queries, 5)) == plain_search(*corpus, 5) and pruned == [5]
