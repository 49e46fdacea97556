"""Hand-computed results for each family of rules."""

import pytest
from pyspark.sql import functions as F

from quarrymind.functions import text as tx
from quarrymind.functions import vectors as vx
from quarrymind.operators import chunking as ch
from quarrymind.operators import feedback as fb
from quarrymind.operators import fusion, graph, learners, ranking, sessions, tables, validation, vector


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(spark, fn, *strings):
    return value(spark, fn(*[F.lit(s) for s in strings]))


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, source string, rank int, doc_id long, score double")


def test_minmax_and_rank(spark):
    h = hits(spark, [(1, "a", 1, 10, 5.0), (1, "a", 2, 11, 3.0), (1, "a", 3, 12, 1.0), (1, "b", 1, 10, 2.0), (1, "b", 2, 11, 2.0)])
    got = {(r.source, r.doc_id): r.norm for r in fusion.normalize_scores(h).collect()}
    assert got == {("a", 10): 1.0, ("a", 11): 0.5, ("a", 12): 0.0, ("b", 10): 0.5, ("b", 11): 0.5}
    h = hits(spark, [(1, "a", 1, 1, 9.0), (1, "a", 2, 2, 7.0), (1, "a", 3, 3, 7.0), (2, "a", 1, 1, 4.0)])
    got = {(r.query_id, r.doc_id): r.norm for r in fusion.normalize_scores(h, "rank").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (1, 3): 0.0, (2, 1): 1.0}


def test_rrf(spark):
    h = hits(spark, [(1, "vector", 1, 7, 0.9), (1, "bm25", 1, 8, 4.0), (1, "bm25", 2, 9, 3.0), (1, "bm25", 3, 7, 2.0)])
    top = fusion.fuse(h, "rrf").first()
    assert top.doc_id == 7 and top.final_score == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)
    assert top.sources == ["bm25", "vector"]


def test_weighted_adds_repeats_but_reports_the_last(spark):
    h = hits(spark, [(1, "vector", 1, 7, 1.0), (1, "vector", 2, 7, 0.5), (1, "vector", 3, 8, 0.0)])
    row = fusion.fuse(h).where("doc_id = 7").first()
    assert row.final_score == pytest.approx(0.5 * (1.0 + 0.5)) and row.vector_score == pytest.approx(0.5)


def test_unknown_source_weighs_little(spark):
    row = fusion.fuse(hits(spark, [(1, "web", 1, 7, 1.0), (1, "web", 2, 8, 0.0)])).first()
    assert row.final_score == pytest.approx(0.1)


def test_dedup_keeps_first_of_near_copies(spark):
    rows = [(1, 1, 1, "a b c", 0.9), (1, 2, 2, "a b c", 0.8), (1, 3, 3, "d e", 0.7)]
    h = spark.createDataFrame(rows, "query_id int, rank int, doc_id long, content string, final_score double")
    assert sorted((r.doc_id, r.rank) for r in fusion.dedup_hits(h).collect()) == [(1, 1), (3, 2)]


def test_mmr_prefers_the_different(spark):
    rows = [(1, 1, 1, "a b c", 0.9), (1, 2, 2, "a b c d", 0.85), (1, 3, 3, "x y z", 0.6)]
    h = spark.createDataFrame(rows, "query_id int, rank int, doc_id long, content string, final_score double")
    assert [r.doc_id for r in fusion.mmr(h, 2, 0.9).orderBy("rank").collect()] == [1, 3]
    assert [r.doc_id for r in fusion.mmr(h, 2, 0.1).orderBy("rank").collect()] == [1, 2]


def test_chunk_ranges(spark):
    got = value(spark, ch._pack(F.array(*[F.lit(c) for c in (3, 4, 5, 2, 6, 1, 1, 9)]), 10, 4))
    assert [tuple(r) for r in got] == [(0, 2), (1, 3), (3, 7), (5, 8)]


def test_hierarchy_parent_and_children(spark):
    body = " ".join(f"Sentence number {i} says something." for i in range(60))
    df = spark.createDataFrame([(1, body), (2, "short one.")], "doc_id long, text string")
    rows = ch.hierarchical_chunk(df, size=64, overlap=8).orderBy("source_id", "chunk_index").collect()
    parent = rows[0]
    assert parent.level == 0 and len(parent.content) <= 512
    assert all(r.parent_chunk_id == parent.chunk_id for r in rows[1:-1] if r.source_id == 1)
    assert rows[-1].source_id == 2 and rows[-1].level == 1 and rows[-1].parent_chunk_id is None


def test_every_sentence_is_in_some_chunk(spark):
    body = " ".join(f"Item {i} holds {'x' * (i % 17)}." for i in range(80))
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    joined = " ".join(r.content for r in ch.chunk_overlapping(df, size=30, overlap=10).collect())
    assert all(s in joined for s in tx_sentences(body))


def tx_sentences(body):
    import re

    return [s for s in re.split(r"(?<=[.!?])\s+", body) if s]


def test_merge_small(spark):
    parts = F.array(*[F.lit(s) for s in ("aaaa", "bbbb", "c" * 40, "d")])
    assert value(spark, ch.merge_small(parts, 3)) == ["aaaa bbbb " + "c" * 40, "d"]


def test_text_rules(spark):
    assert text(spark, tx.clean_whitespace, "  a  \n\t\n \n\n b \n") == "a\n\nb"
    assert text(spark, tx.normalize, "ﬁn\u0007 – x") == "fin - x"
    assert text(spark, tx.strip_markdown, "# T\n> **b** and _i_ [l](u) ![a](p)\n- x\n1. y\n---") == "T\nb and i l a\n• x\n• y"
    assert text(spark, tx.html_to_text, "<h1>T</h1><script>x</script><p>a &amp;lt; b</p><li>c</li>") == "# T\na < b\n\n- c"
    assert text(spark, tx.title, "intro\n# Real title \nrest") == "Real title"
    assert text(spark, tx.title, "a\nb") == "Sin título"
    assert text(spark, tx.title_from_path, "/x/my_long-file.name.md") == "My Long File.name"
    assert text(spark, tx.clean_query, "**what** is (this)? ~x") == "what is this x"
    assert text(spark, lambda c: tx.keywords(c, 2), "Cat dog the cat índice dog índice índice") == ["índice", "cat"]
    assert text(spark, lambda c: tx.snippet(c, 10), "word another more") == "word anoth..."
    assert text(spark, lambda c: tx.snippet(c, 10), "abcdefgh ij kl") == "abcdefgh..."
    assert text(spark, tx.jaccard, "a b c", "B c d") == pytest.approx(0.5)
    assert text(spark, lambda c: tx.split_by(c, ["\n", "; "]), "a; b\n \nc") == ["a; ", "b\n", "c"]
    assert text(spark, lambda c: tx.truncate(c, 4, "middle"), "abcdefghijklmnopqrstuvwx") == "abcd...qrstuvwx"
    assert text(spark, lambda c, q: tx.highlights(c, q, 3, 2), "one cat two cat six", "cat of") == ["...ne cat tw...", "...wo cat si..."]


@pytest.mark.parametrize("x", [0.0, 0.005, 0.125, 0.375, 0.625, 0.695, 1.005, 2.675, 8.005, 12.345, 0.045])
def test_two_decimals_round_like_the_binary_value(spark, x):
    assert value(spark, tx.two_decimals(F.lit(x))) == f"{x:.2f}"


def test_vector_rules(spark):
    a = lambda *xs: F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")
    assert value(spark, vx.cosine(a(1, 2), a(3, 4))) == pytest.approx(0.98387, abs=1e-5)
    assert value(spark, vx.cosine(a(), a())) == 0 and value(spark, vx.cosine(a(0, 0), a(0, 0))) == 0
    assert value(spark, vx.euclidean(a(1), a(1, 2))) == float("inf") and value(spark, vx.dot(a(1, 2), a(3, 4))) == 11
    assert value(spark, vx.l2_normalize(a(0, 0))) == [0.0, 0.0]


def test_mean_vectors(spark):
    df = spark.createDataFrame(
        [("one", 1, [3.0, 4.0]), ("two", 1, [2.0, 0.0]), ("two", 2, [0.0, 2.0]), ("odd", 1, [1.0]), ("odd", 2, [1.0, 2.0])],
        "k string, i int, embedding array<double>",
    )
    got = {r.k: r.embedding for r in vector.avg_embedding(df, "k", order="i").collect()}
    assert got["one"] == [3.0, 4.0] and got["odd"] == [1.0]
    assert got["two"] == pytest.approx([2 ** -0.5, 2 ** -0.5])


def test_ewma_matches_the_recurrence(spark):
    rows = [("k", f"2024-01-0{d} 00:00:00", d, x) for d, x in ((1, 0.2), (2, 0.9), (3, 0.5))]
    df = spark.createDataFrame(rows, "k string, ts string, id int, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ranking.ewma(df, ["k"], "ts", "id", {"fixed": (F.col("x"), 0.3, 0.5), "own": (F.col("x"), 0.2, None)}).first()
    assert out.fixed == pytest.approx(0.5399) and out.n == 3
    assert out.own == pytest.approx(0.2 * 0.5 + 0.8 * (0.2 * 0.9 + 0.8 * 0.2))


def test_signal_values(spark):
    rows = [("rating", "1", 0.0), ("rating", "3", 0.5), ("rating", "5", 1.0), ("rating", None, 0.5), ("rating", "bad", 0.5),
            ("dwell_time", "4", 0.2), ("dwell_time", "5", 0.4), ("dwell_time", "15", 0.6), ("dwell_time", "30", 0.8), ("dwell_time", "60", 1.0),
            ("scroll_depth", "150", 1.0), ("click", "0", 0.3), ("copy", "1", 0.8), ("report", None, 0.0), ("nonsense", "5", 1.0)]
    df = spark.createDataFrame([(i, k, r, v) for i, (k, r, v) in enumerate(rows)], "i int, signal_type string, raw_value string, want double")
    assert all(r.value == pytest.approx(r.want) for r in fb.parse_signals(df).collect())


def test_one_report_gives_full_accuracy(spark):
    df = spark.createDataFrame([(1, "report", None, 1, "2024-01-01")], "signal_id int, signal_type string, raw_value double, query_id int, ts string")
    assert fb.weight_feedback(fb.parse_signals(df)).first().accuracy_score == 1.0


def test_quality_bands(spark):
    got = [value(spark, fb.quality(F.lit(x))) for x in (0.85, 0.7, 0.5, 0.3, 0.29)]
    assert got == ["excellent", "good", "fair", "poor", "critical"]


def edge_rows(spark, rows):
    return spark.createDataFrame(rows, "edge_type string, src long, dst long, weight double, confidence double, negative_signals int")


def feedback_rows(spark, rows):
    df = spark.createDataFrame(rows, "feedback_id long, ts string, overall_score double, confidence double, chunk_ids array<long>, concept_ids array<long>")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_reinforce_and_weaken_steps(spark):
    e = edge_rows(spark, [("relates_to", 1, 2, 0.99, 0.8, 0), ("evidenced_by", 1, 9, 0.15, 0.8, 0)])
    good = feedback_rows(spark, [(1, "2024-01-01", 0.8, 0.5, [], [2, 1])])
    bad = feedback_rows(spark, [(1, "2024-01-01", 0.1, 1.0, [9], [1])])
    assert graph.edge_updates(good).first().delta == pytest.approx(0.02)
    assert graph.reinforce(good, e).where("dst = 2").first().weight == 1.0
    row = graph.weaken(bad, e).where("dst = 9").first()
    assert row.weight == pytest.approx(0.1) and row.negative_signals == 1
    assert graph.edge_updates(bad).first().delta == pytest.approx(-0.072)


def test_mixed_steps_follow_arrival_order(spark):
    import random

    rng = random.Random(3)
    e = edge_rows(spark, [("evidenced_by", 1, 9, 0.9, 0.8, 0)])
    rows = [(i, f"2024-01-0{1 + i % 3} {i % 24:02d}:00:00", rng.choice([0.05, 0.95]), 1.0, [9], [1]) for i in range(120)]
    want = 0.9
    for _, _, score, _, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want = min(1.0, want + 0.05 * score) if score >= 0.6 else max(0.1, want - 0.08 * (1 - score))
    got = graph.apply_feedback(feedback_rows(spark, rows), e)["edges"].first().weight
    assert got == pytest.approx(want)


def test_paths_stop_at_the_target_and_never_repeat(spark):
    e = edge_rows(spark, [("relates_to", a, b, 0.5, 0.8, 0) for a, b in ((1, 2), (2, 3), (3, 4), (1, 3), (2, 4))])
    pairs = spark.createDataFrame([(1, 4)], "source long, target long")
    got = sorted(tuple(r.nodes) for r in graph.paths_between(pairs, e, 4).collect())
    assert got == [(1, 2, 3, 4), (1, 2, 4), (1, 3, 2, 4), (1, 3, 4)]


def test_path_rankings(spark):
    e = edge_rows(spark, [("relates_to", 1, 2, 1.0, 0.8, 0), ("relates_to", 2, 3, 0.5, 0.8, 0), ("relates_to", 1, 3, 0.2, 0.8, 0)])
    nodes = spark.createDataFrame([(1, "concept"), (2, "topic"), (3, "concept")], "node_id long, node_type string")
    paths = graph.paths_between(spark.createDataFrame([(1, 3)], "source long, target long"), e, 2)
    first = lambda method: graph.rank_paths(paths, method, nodes).where("rank = 1").first()
    assert first("weighted").nodes == [1, 2, 3] and first("weighted").total_score == pytest.approx(2.5 / 3)
    assert first("shortest").nodes == [1, 3] and first("shortest").total_score == pytest.approx(1 / 3)
    assert first("coverage").total_score == pytest.approx(2 / 5)


def test_expansion_takes_the_best_route(spark):
    e = edge_rows(spark, [("relates_to", 1, 2, 0.5, 0.8, 0), ("relates_to", 1, 3, 1.0, 0.8, 0), ("relates_to", 3, 2, 1.0, 0.8, 0), ("belongs_to", 1, 4, 1.0, 0.8, 0)])
    got = {r.node_id: (r.score, r.path) for r in graph.expand(spark.createDataFrame([(1, 1)], "query_id long, node_id long"), e).collect()}
    assert got[2] == (pytest.approx(0.64), [1, 3, 2]) and 4 not in got


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(1, "concept", "a"), (2, "concept", ""), (1, "concept", "a"), (3, "planet", "x")], "node_id long, node_type string, name string")
    e = edge_rows(spark, [("relates_to", 1, 9, 1.0, 0.8, 0), ("relates_to", 8, 9, 1.0, 0.8, 0), ("relates_to", 1, 2, 11.0, 0.8, 0), ("contrasts", 1, 2, 1.0, 0.8, 0)])
    errors = sorted((r.item, r.error) for r in validation.validate_graph(nodes, e).collect())
    assert errors == [
        ("1", "duplicate id"), ("1-relates_to-2", "weight out of range"), ("1-relates_to-9", "destination does not exist"),
        ("2", "missing field: name"), ("3", "unsupported node type: planet"), ("8-relates_to-9", "origin does not exist"),
    ]


def turns_of(spark, tokens, concepts=None):
    rows = [(1, i, "user", "x", concepts[i] if concepts else [], t) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "session_id long, turn_no int, role string, content string, concepts array<long>, token_count int")


def test_retention_equals_the_insert_rule(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        tokens = [rng.choice([0, 10, 50, 200, 400]) for _ in range(30)]
        held = []
        for i, t in enumerate(tokens):
            while len(held) > 2 and sum(tokens[j] for j in held) + t > 500:
                held.pop(0)
            held = [*held, i][-6:]
        got = sorted(r.turn_no for r in sessions.retained_turns(turns_of(spark, tokens), 6, 500).collect())
        assert got == held


def test_active_concepts_leave_and_return(spark):
    named = [[1, 2], [3], [1], [4], [1]]
    got = sessions.active_concepts(turns_of(spark, [1] * 5, named), 3).first()
    assert got.concepts == [3, 4, 1]


def test_levels_and_weakness_rules(spark):
    assert value(spark, learners.level_of(F.lit(1.0), F.lit(0.5))) == "intermediate"
    rows = [(i, 1, c, s, False, "2024-01-01") for i, (c, s) in enumerate([(1, 0.3), (2, 0.3), (2, 0.3), (3, 0.3), (3, 0.3), (3, 0.3)])]
    df = spark.createDataFrame(rows, "interaction_id int, student_id int, concept_id int, score double, confused boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.concept_id: r.is_weakness for r in learners.mastery(df).collect()} == {1: True, 2: False, 3: True}


def test_upsert_and_partial_update(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (1, "old", 0)], "k int, v string, ver int")
    assert sorted(map(tuple, tables.upsert(base, new, ["k"], "ver").collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 1)]
    part = spark.createDataFrame([(1, None, 5), (2, "z", 6)], "k int, v string, ver int")
    assert sorted((r.k, r.v) for r in tables.merge_update(base, part, ["k"], "ver").collect()) == [(1, "a"), (2, "z")]


def test_strategy_retrieval_on_a_small_corpus(spark):
    """Every settings row against a brute-force rendering of the same rules."""
    from quarrymind.operators import lexical, routing
    from quarrymind.plans import retrieval as rp

    kinds = ["exercise", "worked_example", "chunk"]
    words = ["alpha", "beta", "gamma", "delta"]
    chunks = [(f"chunk:{i}", f"{words[i % 4]} {words[(i + 1) % 4]} note{i} item{i}", '{"chunk_type": "%s", "title": "T%d"}' % (kinds[i % 3], i)) for i in range(12)]
    vectors = [(f"chunk:{i}", [float(i % 5) + 1, float(i % 3), 1.0]) for i in range(12)]
    docs = spark.createDataFrame(chunks, "chunk_id string, content string, metadata string")
    nodes = spark.createDataFrame([("concept:1", "concept", "zzz", "nothing here")], "node_id string, node_type string, name string, description string")
    edges = spark.createDataFrame([("relates_to", "concept:1", "concept:2", 1.0, 0.8, 0)], "edge_type string, src string, dst string, weight double, confidence double, negative_signals int")
    corpus = rp.Corpus(lexical.build_index(docs, "chunk_id", "content"), spark.createDataFrame(vectors, "chunk_id string, embedding array<float>"), docs, nodes, edges)
    asked = spark.createDataFrame([(0, "alpha beta", [1.0, 0.0, 0.0], "practice"), (1, "gamma", [1.0, 2.0, 1.0], "exercise_list")], "query_id long, text string, embedding array<float>, mode string")
    rows = rp.retrieve_with_strategy(routing.strategy_for(asked, "basic"), corpus).collect()

    kind_of = {c: kinds[i % 3] for i, (c, _, _) in enumerate(chunks)}
    listed = [r for r in rows if r.query_id == 1]
    assert listed and all(kind_of[r.doc_id] == "exercise" and r.content == "" and r.exercise_title.startswith("T") for r in listed)

    query = asked.where("query_id = 0")
    lists = {}
    for source, found in (("vector", rp.vector_hits(query, corpus, 20)), ("bm25", rp.bm25_hits(query, corpus, 20))):
        got = [(r.doc_id, r.score) for r in found.orderBy("rank").collect() if source == "bm25" or r.score >= 0.24]
        preferred = [(d, s) for d, s in got if kind_of[d] == "worked_example"]
        lists[source] = preferred or got
    total = {}
    for source, weight in (("vector", 0.4), ("bm25", 0.3)):
        scores = [s for _, s in lists[source]]
        low, high = min(scores), max(scores)
        for d, s in lists[source]:
            total[d] = total.get(d, 0.0) + weight * (0.5 if high == low else (s - low) / (high - low))
    want = sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = [(r.doc_id, r.final_score) for r in sorted((r for r in rows if r.query_id == 0), key=lambda r: r["rank"])]
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
