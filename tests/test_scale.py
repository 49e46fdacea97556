"""Large-input routes give the rows of the small-input routes, and no key rules the layout."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymind.catalog.common import table
from quarrymind.operators import graph, lexical, ranking, tables, vector
from quarrymind.plans import retrieval
from quarrymind.session import scratch, shared_dir, small_side

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_do_not_change_the_hits(spark):
    v = table(spark, SF, "embeddings")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert rows(vector.vector_search(v, q, 5)) == rows(vector.vector_search(v, q, 5, block_values=6400))


def test_cells_give_the_exact_hits_and_leave_blocks_out(spark):
    v = table(spark, SF, "embeddings")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    cells, centers = vector.build_ivf(v, 4)
    exact = vector.vector_search(v, q, 5, 0.0)
    assert rows(vector.ivf_search(cells, centers, q, 5, nprobe=4, block_values=3200)) == rows(exact)
    assert rows(vector.cell_search(cells, centers, q, 5, block_values=3200)) == rows(exact)
    others = v.select("vec_id")
    assert rows(vector.similar_items(v, others, 3, 0.1, index=(cells, centers))) == rows(vector.similar_items(v, others, 3, 0.1))
    near = {(r.query_id, r.doc_id) for r in vector.ivf_search(cells, centers, q, 5, nprobe=2).collect()}
    want = {(r.query_id, r.doc_id) for r in exact.collect()}
    assert len(near & want) / len(want) > 0.5
    # Clear clusters: the bound proves that most cells hold no hit.
    points = [(10 * c + i, [float(c == d) + 0.01 * (i + 1) * (d == (c + 1) % 6) for d in range(6)]) for c in range(6) for i in range(8)]
    v = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    cells, centers = vector.build_ivf(v, 6)
    near = vector._near_cells(centers, q).collect()
    fifth = {r.query_id: r.score for r in vector.vector_search(v, q, 5).where("rank = 5").collect()}
    assert sum(r.best >= fifth[r.query_id] for r in near) <= len(near) / 2
    assert rows(vector.cell_search(cells, centers, q, 5)) == rows(vector.vector_search(v, q, 5))


def test_dimensions_do_not_depend_on_row_order(spark):
    items = [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0]), ("e", []), ("n", None)]
    asked = [("q", [1.0, 0.0, 0.0]), ("r", [1.0, 0.0])]
    for order in (1, -1):
        v = spark.createDataFrame(items[::order], "vec_id string, embedding array<double>").coalesce(1)
        q = spark.createDataFrame(asked[::order], "query_id string, embedding array<double>").coalesce(1)
        got = sorted((r.query_id, r.doc_id, r.score) for r in vector.vector_search(v, q, 3).collect())
        assert got == [("q", "b", 1.0), ("q", "c", 0.0), ("r", "a", 1.0)]


def test_text_ids_and_ragged_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [0.0, 0.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    got = [(r.doc_id, r.score) for r in vector.vector_search(v, q, 3).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("d", 0.0)]


def test_ewma_of_a_hot_key_is_spread_over_time(spark):
    rng = random.Random(1)
    data = [("hot", f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", i, rng.random()) for i in range(600)] + [("cold", "2024-01-01 00:00:00", 0, 0.4)]
    df = spark.createDataFrame(data, "k string, ts string, id int, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.k: r.s for r in ranking.ewma(df, ["k"], "ts", "id", {"s": (F.col("x"), 0.3, 0.5)}).collect()}
    want = 0.5
    for _, _, _, x in sorted((d for d in data if d[0] == "hot"), key=lambda d: (d[1], d[2])):
        want = 0.3 * x + 0.7 * want
    assert got["hot"] == pytest.approx(want) and got["cold"] == pytest.approx(0.3 * 0.4 + 0.35)


def test_number_rows_matches_a_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101 / 10).alias("x"), "id")
    got = ranking.number_rows(df, ["k"], -F.floor("x"), [F.col("x").desc(), F.col("id")])
    expected = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, -r.x, r.id)):
        expected.setdefault(r.k, []).append(r.id)
    assert all(expected[r.k][r["rank"] - 1] == r.id for r in got.collect())


def test_as_of_matches_brute_force(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), rng.randrange(0, 50000), i) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(0, 50000), i) for i in range(80)]
    to_ts = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    got = ranking.as_of(
        to_ts(spark.createDataFrame(left, "k string, ts long, i int"), "ts"), to_ts(spark.createDataFrame(right, "k string, at long, p int"), "at"),
        ["k"], "ts", "at", ["p"], "p",
    )
    best = {}
    for k, t, i in left:
        before = [(at, p, p) for rk, at, p in right if rk == k and at <= t]
        best[i] = max(before)[2] if before else None
    assert {r.i: r.p for r in got.collect()} == best


def test_substring_pairs_match_brute_force(spark):
    rng = random.Random(4)
    strings = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    patterns = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(30)})
    got = lexical.substring_pairs(
        spark.createDataFrame([(s,) for s in set(strings)], "string string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    )
    assert rows(got) == sorted((s, p) for s in set(strings) for p in patterns if p in s)


def test_results_do_not_depend_on_partitioning(spark):
    df = table(spark, SF, "documents")
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    one = rows(lexical.bm25_search(lexical.build_index(df), q, 5))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(lexical.bm25_search(lexical.build_index(df.repartition(5)), q, 5)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.isfinite([r[2] for r in one]).all()


def test_an_index_that_grew_equals_one_built_at_once(spark, tmp_path):
    docs = table(spark, SF, "documents")
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    whole = lexical.build_index(docs, folder=str(tmp_path / "whole"))
    lexical.add_to_index(docs.where("doc_id % 2 = 0"), str(tmp_path / "grown"))
    lexical.add_to_index(docs.where("doc_id % 2 = 1"), str(tmp_path / "grown"))
    grown = lexical.load_index(spark, str(tmp_path / "grown"))
    assert rows(lexical.bm25_search(grown, q, 5)) == rows(lexical.bm25_search(whole, q, 5))
    assert rows(grown.totals) == rows(whole.totals) and rows(grown.terms) == rows(whole.terms)
    assert rows(lexical.bm25_search(lexical.build_index(docs, saved=False), q, 5)) == rows(lexical.bm25_search(whole, q, 5))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    index = lexical.build_index(table(spark, SF, "documents"), folder=str(tmp_path / "index"))
    q = table(spark, SF, "benchmark").limit(1).select(F.col("item_id").alias("query_id"), F.lit("the").alias("text"))
    plan = plan_of(lexical.bm25_search(index, q, 5))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= \d+|IN)", plan), plan


def test_hits_meet_their_texts_in_place(spark):
    """The few ids are sent to the texts: nothing above the scan of the texts is exchanged."""
    texts = table(spark, SF, "documents").select("doc_id", F.col("text").alias("content"))
    ids = spark.createDataFrame([(1,), (2,), (10**9,)], "doc_id long")
    plan = plan_of(texts.join(small_side(ids), "doc_id"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    hits = spark.createDataFrame([(1, 5, 0.5), (1, 10**9, 0.4)], "query_id long, doc_id long, final_score double")
    corpus = retrieval.Corpus(None, None, texts.withColumnRenamed("doc_id", "chunk_id"), spark.createDataFrame([], "node_id long, description string"), None)
    got = {r.doc_id: r.content for r in retrieval._with_content(hits, corpus).collect()}
    assert got[10**9] == "" and len(got[5]) > 0


def test_scratch_folders_go_with_their_block(spark):
    base = shared_dir(spark).removeprefix("file:")
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    before = set(os.listdir(base))
    with scratch(spark) as folder:
        found = rows(lexical.bm25_search(lexical.build_index(table(spark, SF, "documents")), q, 5))
        assert os.listdir(folder.removeprefix("file:"))
    assert found and set(os.listdir(base)) == before


def test_expansion_takes_what_is_asked(spark):
    star = spark.createDataFrame([("relates_to", 0, i, 0.9, 0.8, 0) for i in range(1, 201)], "edge_type string, src long, dst long, weight double, confidence double, negative_signals int")
    seeds = spark.createDataFrame([(1, 0)], "query_id long, node_id long")
    assert graph.expand(seeds, star, 3, 150).count() == 150
    assert graph.expand(seeds, star, 1, None).count() == 201
    nodes, links = graph.subgraph(seeds, star)
    assert nodes.count() == 201 and links.count() == 200
    chain = spark.createDataFrame([("relates_to", i, i + 1, 1.0, 0.8, 0) for i in range(6)], star.schema)
    assert graph.expand(seeds, chain, 6, None, 0.1).agg(F.max("depth")).first()[0] == 6


def test_listed_sources_count_all(spark):
    stored = spark.createDataFrame([(f"s{i}", "t", "text", 1, None) for i in range(5)], "source_id string, title string, content_type string, total_chunks int, created_at timestamp")
    runs = spark.createDataFrame([("r", "s4", "completed", "m", 1, None, None)], "run_id string, source_id string, status string, message string, chunks_created int, started_at timestamp, completed_at timestamp")
    got = tables.list_sources(stored, runs, 3).collect()
    assert len(got) == 3 and {r.total for r in got} == {5}


def test_steps_of_one_minute_fold_in_blocks(spark):
    rng = random.Random(3)
    data = [("concept", 1, 2, *(("reinforce", 0.04) if rng.random() < 0.5 else ("weaken", -0.05)), "2024-01-01 00:00:00", i) for i in range(700)]
    updates = spark.createDataFrame(data, "link string, a long, b long, action string, delta double, ts string, feedback_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    edge = spark.createDataFrame([("relates_to", 1, 2, 0.5, 0.8, 0)], "edge_type string, src long, dst long, weight double, confidence double, negative_signals int")
    want = 0.5
    for _, _, _, action, delta, _, _ in data:
        want = min(1.0, want + delta) if action == "reinforce" else max(0.1, want + delta)
    for block in (7, 1000):
        got = graph.apply_folded(edge, graph.fold_updates(updates, block=block)).first()
        assert got.weight == pytest.approx(want) and got.negative_signals == sum(d[3] == "weaken" for d in data)


def test_one_key_with_nearly_all_rows_at_one_time_and_score(spark):
    """Nine of ten rows share key, time and score: ties decide, and nothing is lost or doubled."""
    rng = random.Random(5)
    data = [("hot" if i % 10 else f"k{i}", "2024-01-01 00:00:00", i, 0.5 if i % 10 else rng.random()) for i in range(600)]
    df = spark.createDataFrame(data, "k string, ts string, id int, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    numbered = ranking.number_rows(df, ["k"], -F.floor(F.col("x") * 1000), [F.col("x").desc(), F.col("id")])
    hot = [r["rank"] for r in numbered.where("k = 'hot'").orderBy("id").collect()]
    assert hot == list(range(1, len(hot) + 1)) and len(hot) == 540
    means = {r.k: (r.n, r.s) for r in ranking.ewma(df, ["k"], "ts", "id", {"s": (F.col("x"), 0.3, 0.2)}).collect()}
    assert means["hot"][0] == 540 and means["hot"][1] == pytest.approx(0.5 + (0.2 - 0.5) * 0.7**540)
    halves = [df.where(f"id % 2 = {b}").withColumn("batch", F.lit(b)) for b in (0, 1)]
    values = {"s": (F.col("x"), 0.3, 0.2)}
    parts = [ranking.ewma_parts(h, ["k"], "ts", "id", values).withColumn("batch", F.lit(b)) for b, h in enumerate(halves)]
    merged = ranking.ewma_totals(ranking.ewma_fold(parts[0].unionByName(parts[1]), ["k"], values, "batch"), ["k"], values)
    assert {r.k: r.n for r in merged.collect()} == {k: n for k, (n, _) in means.items()}
    asked = df.select("k", F.col("ts"), "id")
    newest = ranking.as_of(asked, df.select("k", F.col("ts").alias("at"), F.col("id").alias("p")), ["k"], "ts", "at", ["p"], "p")
    assert {r.p for r in newest.where("k = 'hot'").collect()} == {max(i for k, _, i, _ in data if k == "hot")}


def test_best_scores_are_found_without_sorting_all(monkeypatch):
    """Ties go to the smaller place, as a whole stable sort has it; only rows' best scores are sorted."""
    import numpy as np

    from quarrymind.operators import vector

    draw = np.random.default_rng(5)
    for n, k in ((30, 5), (5, 5), (3, 9), (200, 1), (50, 20)):
        scores = np.round(draw.random((40, n)), 1)
        scores[:3], scores[5, ::2] = -np.inf, -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows, places = vector._first(scores, k)
        assert (rows == np.repeat(np.arange(40), top.shape[1])).all() and (places == top.ravel()).all()
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    vector._first(draw.random((100, 5000)), 5)
    assert sizes == [500]


def test_texts_are_not_ranked(spark, monkeypatch):
    from quarrymind.catalog import pipeline

    ranked, number = [], pipeline.number_rows
    monkeypatch.setattr(pipeline, "number_rows", lambda df, *rest: ranked.append(df.columns) or number(df, *rest))
    pipeline.prompt_context(spark, "/root/testdata/sf0.001")
    assert len(ranked) == 1 and "content" not in ranked[0]


def test_paths_make_their_edges_once(spark, monkeypatch):
    from quarrymind.operators import graph

    made, write = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label: made.append(label) or write(df, label))
    edges = spark.createDataFrame([("relates_to", n, n + 1, 0.5) for n in range(6)], "edge_type string, src long, dst long, weight double")
    found = graph.paths_between(spark.createDataFrame([(0, 3)], "source long, target long"), edges, 3, 0.3)
    assert [r.nodes for r in found.collect()] == [[0, 1, 2, 3]] and made.count("edges") == 1


def test_last_step_keeps_walks_that_can_meet(spark, monkeypatch):
    from quarrymind.operators import graph

    sizes, write = [], graph.cut_lineage

    def counted(df, label):
        out = write(df, label)
        if label == "walks":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    # 0 has 40 neighbours of 40 others each, 1 has 40 neighbours; one edge joins the two sides.
    rows = [(0, 100 + a) for a in range(40)] + [(100 + a, 1000 + 40 * a + b) for a in range(40) for b in range(40)]
    rows += [(1, 5000 + b) for b in range(40)] + [(107, 5003)]
    edges = spark.createDataFrame([("relates_to", a, b, 0.5) for a, b in rows], "edge_type string, src long, dst long, weight double")
    found = graph.paths_between(spark.createDataFrame([(0, 1)], "source long, target long"), edges, 3, 0.3)
    assert [r.nodes for r in found.collect()] == [[0, 107, 5003, 1]]
    assert len(sizes) == 3 and max(sizes) <= 200


def test_paths_equal_brute_force(spark):
    import random

    from quarrymind.operators import graph

    draw = random.Random(3)
    rows = {(draw.randrange(14), draw.randrange(14)) for _ in range(40)}
    rows |= {(0, n) for n in range(14)}  # a node that is next to all others
    edges = spark.createDataFrame([("relates_to", a, b, 0.5) for a, b in rows], "edge_type string, src long, dst long, weight double")
    near = {n: sorted({b for a, b in rows if a == n} | {a for a, b in rows if b == n}) for n in range(14)}

    def plain(walk, target, left):
        if walk[-1] == target:
            return [tuple(walk)]
        return [p for n in near[walk[-1]] if left and n not in walk for p in plain([*walk, n], target, left - 1)]

    pairs = [(0, 5), (5, 0), (3, 9), (7, 7), (2, 13)]
    asked = spark.createDataFrame(pairs, "source long, target long")
    for most in (1, 2, 3, 5):
        found = [tuple(r.nodes) for r in graph.paths_between(asked, edges, most, 0.3).collect()]
        assert sorted(found) == sorted(p for s, t in pairs for p in plain([s], t, most))


def test_marks_never_lose_a_node(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarrymind.operators import graph

    monkeypatch.setattr(graph, "MARK_WORDS", 4)
    walks = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 7)).alias("source"), F.lit(1).cast("long").alias("target"), F.array("id").alias("nodes"))
    marks = graph._marked(walks)
    held = walks.join(marks, ["source", "target"]).withColumn("hashed", F.xxhash64(F.element_at("nodes", -1)))
    assert held.where(graph._may_hold("marks", "hashed")).count() == 3000 and marks.agg(F.max(F.size("marks"))).first()[0] == 4
