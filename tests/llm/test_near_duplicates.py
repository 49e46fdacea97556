"""Near-duplicate groups against brute force over whole shingle sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarrymind.llm import simhash


def shingles(words):
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_groups(rows, least=0.8):
    sets, group = [shingles(w) for w in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    return sorted(sorted(i for i in range(len(rows)) if root(i) == r) for r in {root(i) for i in range(len(rows))})


def found_groups(spark, rows):
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    groups = {}
    for r in simhash.near_duplicates(table).collect():
        groups.setdefault(r.root, []).append(r.id)
    return sorted(map(sorted, groups.values()))


def test_many_variants_of_one_text(spark):
    """Most variants are similar to the base alone, or to nothing, and all share their bands' values with many others."""
    draw = random.Random(7)
    base = [f"b{draw.randrange(500)}" for _ in range(200)]
    rows = [base]
    for n in range(250):
        words = list(base)
        for at in draw.sample(range(200), draw.choice([3, 4, 5, 6])):
            words[at] = f"n{n}x{at}"
        rows.append(words)
    lines = [[f"l{k}w{draw.randrange(300)}" for _ in range(20)] for k in range(12)]
    for _ in range(60):
        order = list(lines)
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(11)
            order[at], order[at + 1] = order[at + 1], order[at]
        rows.append(sum(order, []))
    draw.shuffle(rows)
    want = plain_groups(rows)
    assert len(want) > 20 and max(map(len, want)) > 100
    assert found_groups(spark, rows) == want


def test_long_texts_are_decided_exactly(spark):
    """Pairs of 2,000 shingles close to the threshold, on both sides of it."""
    rows = []
    for k in range(40):
        words = [f"k{k}w{i}" for i in range(2004)]
        rows += [words, words[: 2004 - 2000 * (18 + k % 5) // 100]]
    want = plain_groups(rows)
    assert 20 < len(want) < len(rows)
    assert found_groups(spark, rows) == want


def test_added_cut_and_replaced_passages_meet():
    """Two texts of similarity 0.8 or more share a band, whatever the edit."""
    draw = random.Random(3)
    for _ in range(200):
        n = draw.choice([60, 300, 1500])
        words, other = ([f"{k}{draw.randrange(4000)}" for _ in range(n)] for k in "wo")
        few, at = draw.randint(1, n // 5), draw.randrange(n * 4 // 5)
        for edited in (words[:at] + other[:few] + words[at:], words[:at] + words[at + few :], words[:at] + other[: few // 2] + words[at + few // 2 :]):
            a, b = shingles(words), shingles(edited)
            if len(a & b) >= 0.8 * len(a | b):
                bands = [simhash.bands_of(simhash.minima(simhash.shingle_hashes([w.encode() for w in ws], 5))[None]) for ws in (words, edited)]
                assert (bands[0] == bands[1]).any()


def test_fingerprint_links_propose_pairs(spark, monkeypatch):
    """Near copies are proposed by the links of their fingerprints before any band."""
    draw = random.Random(5)
    rows = []
    for k in range(30):
        words = [f"k{k}w{draw.randrange(3000)}" for _ in range(600)]
        rows += [words, [*words, f"more{k}"]]
    want = plain_groups(rows)
    asked, inner = [], simhash.linked_prints
    monkeypatch.setattr(simhash, "linked_prints", lambda nodes: asked.append(1) or inner(nodes))
    assert found_groups(spark, rows) == want and asked == [1]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    prints = simhash.described(table, "doc_id", "text", 5).select("node", "fp")
    pairs = {frozenset((r.a, r.b)) for r in simhash.linked_prints(prints).collect()}
    nodes = {r.id: r.node for r in simhash.described(table, "doc_id", "text", 5).collect()}
    assert sum(frozenset((nodes[2 * k], nodes[2 * k + 1])) in pairs for k in range(30)) > 20


def test_texts_without_a_key_are_not_moved(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("_text"))
    keys = simhash.cut_lineage(rows.where("_text % 100 = 0").select("key"), "keys")
    near = simhash.possibly_of(rows, keys)
    assert near.columns == rows.columns and near.join(keys, "key", "left_semi").count() == 200
    assert near.count() < 200 + 20000 / 10
    assert simhash.possibly_of(rows, simhash.cut_lineage(keys.limit(0), "keys")).count() == 0


def test_shingle_sets_filter_texts_before_their_join(spark, monkeypatch):
    asked, possibly = [], simhash.possibly_of
    monkeypatch.setattr(simhash, "possibly_of", lambda rows, keys: asked.append(rows.columns) or possibly(rows, keys))
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(50)], "doc_id long, text string")
    keys = simhash.cut_lineage(docs.where("doc_id < 3").select(simhash.row_key("doc_id", "text").alias("key"), F.col("doc_id").alias("node")), "keys")
    assert sorted(r.node for r in simhash.shingle_sets(docs, keys, "doc_id", "text", 5).collect()) == [0, 1, 2]
    assert asked == [["key", "_text"]]


def test_stars_need_no_round(spark, monkeypatch):
    from quarrymind.llm import components as module

    made, write = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, label: made.append(label) or write(df, label))
    stars = spark.createDataFrame([(0, 1), (2, 0), (3, 0), (7, 9)], "a long, b long")
    assert sorted(tuple(r) for r in module.components(stars).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (7, 7), (9, 7)]
    assert made == ["edges"]
    chain = spark.createDataFrame([(i * 7 % 41, (i + 1) * 7 % 41) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in module.components(chain).collect()} == {(i, 0) for i in range(41)}
    assert module.components(stars.limit(0)).count() == 0


def test_each_two_rows_of_a_band_are_compared_once(monkeypatch):
    compared = []
    monkeypatch.setattr(simhash, "jaccard", lambda x, y: compared.append(1) or 0.0)
    marks = simhash.signatures(simhash.minima(np.arange(1, 100, dtype=np.uint64) << np.uint64(32))[None])
    assert marks.nbytes == 80
    rows = {
        "node": np.arange(100), "size": np.full(100, 9), "root": np.arange(100), "bytes": [marks.tobytes()] * 100,
        "set": [np.arange(i, i + 9, dtype="<u8").tobytes() for i in range(100)],
    }
    assert simhash.connecting(0.8)(rows) == ([], []) and len(compared) == 100 * 99 / 2
