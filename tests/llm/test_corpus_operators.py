"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quarrymind.llm import components, simhash, substrings, tiling

# ---- components ----


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 260)] + [(a, b) for a in range(300, 306) for b in range(a, 306)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges + edges[:5], "a long, b long"))
    want = {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in [*range(200, 260), 500]}, **{i: 300 for i in range(300, 306)}}
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash ----

def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    ids = sorted({i for i, _ in prints if i is not None})
    group = {f: f for _, f in prints}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    distinct = list(group)
    for k, f in enumerate(distinct):
        for g in distinct[:k]:
            if (f ^ g).bit_count() <= radius:
                group[root(f)] = root(g)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in prints), key=repr), ids


def test_simhash_equals_brute_force(spark, copies, edge):
    for table in (spark.createDataFrame(copies, "doc_id long, text string").repartition(3), edge):
        prints = [(r.doc_id, plain_print(r.text)) for r in table.collect()]
        got = simhash.near_print_components(simhash.fingerprints(table))
        rows = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got.collect()]
        assert sorted(rows, key=repr) == plain_components(prints)[0]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_links_connect_all_close_prints(spark, radius):
    draw = random.Random(radius)
    seeds = [draw.getrandbits(64) for _ in range(40)]
    prints = {s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for s in seeds for _ in range(12)} | set(seeds)
    signed = [np.uint64(p).view(np.int64).item() for p in prints]
    nodes = spark.createDataFrame([(p, [p]) for p in signed], "node long, fps array<long>").repartition(3)
    found = {r.node: r.component for r in components.components(simhash.links(nodes, radius)).collect()}
    want, _ = plain_components([(i, p % 2**64) for i, p in enumerate(signed)], radius)
    mine = [(found.get(p, p), w[2]) for p, w in zip(signed, sorted(want))]
    assert len(set(mine)) == len({a for a, _ in mine}) == len({b for _, b in mine})


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << b) for b in range(62)] + [base ^ (1 << b) ^ (1 << (b + 1)) for b in range(0, 60, 3)]
    nodes = spark.createDataFrame([(i, [p]) for i, p in enumerate(prints)], "node long, fps array<long>")
    found = components.components(simhash.links(nodes)).collect()
    assert {r.component for r in found} == {0} and len(found) == len(prints)


def test_plan_gives_out_all_units():
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2, size=(2000, 64))
    bits[:, 32:48] = bits[:, :16]  # correlated halves
    both = (bits.T @ bits).astype(float)
    for rows in (2000, 10**7, 10**10):
        for radius in (0, 1, 3, 6):
            parts = simhash.plan(rows, both, radius)
            assert sum(p.threshold + 1 for p in parts) == radius + 1
            used = [b for p in parts for b in p.bits]
            assert len(set(used)) == len(used)
    few, many = simhash.plan(2000, both, 3), simhash.plan(10**11, both * 5e7, 3)
    assert len(many) <= len(few) and max(p.threshold for p in many) >= max(p.threshold for p in few)


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def test_near_duplicates_are_similar_by_shingles(spark):
    draw = random.Random(2)
    rows = []
    for i in range(60):
        words = [f"w{draw.randrange(900)}" for _ in range(draw.choice([30, 120, 400]))]
        rows.append(words)
        if i % 3 == 0:
            for changes in (0, 1, len(words) // 100, len(words) // 4):
                copy = list(words)
                for _ in range(changes):
                    copy[draw.randrange(len(copy))] = f"n{draw.randrange(900)}"
                rows.append(copy)
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r.id: r.root for r in simhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in table]
    close = lost = 0
    for a in range(len(table)):
        for b in range(a):
            similar = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if similar >= 0.8:
                close, lost = close + 1, lost + (got[a] != got[b])
    assert close > 30 and lost == 0


def test_likeness_of_marks():
    draw = np.random.default_rng(4)
    for size, shared in ((10, 9), (200, 170), (4000, 3600), (4000, 1000)):
        both = draw.integers(0, 2**63, size=shared).astype(np.uint64) * np.uint64(2)
        a, b = (np.concatenate([both, draw.integers(0, 2**63, size=size - shared).astype(np.uint64) * np.uint64(2)]) for _ in range(2))
        want = shared / (2 * size - shared)
        marks = simhash.signatures(np.array([simhash.minima(a), simhash.minima(b)]))
        near = simhash.likeness(marks, marks)
        assert abs(near[0, 1] - want) < 0.15 and near[0, 0] == near[1, 1] == 1
        assert simhash.jaccard(np.unique(a), np.unique(b)) == pytest.approx(want)
    assert simhash.jaccard(np.zeros(0), np.zeros(0)) == 1.0


def test_one_row_of_each_group_stays(spark, edge, nothing):
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    by_text = [r.text for r in kept.collect()]
    # Null, empty and blank texts are one group; the long texts are copies; the repeated row and its copy are one group.
    assert len(by_text) == 7 and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 8, 9]
    assert simhash.drop_near_duplicates(nothing).count() == 0


# ---- repeated passages ----

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(t or "")
        covered = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen:
                covered[s : s + length] = [True] * length
            seen.add(key)
        kept = [w for w, c in zip(words, covered) if not c]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [4, 8, 20])
def test_removal_equals_brute_force(spark, copies, length):
    rows = [*copies, (1000, None), (1001, ""), (1002, "same " * 50), (1003, "same " * 50), (1004, " ".join(["a", "b", "c"] * 30)), (None, copies[5][1] + " " + copies[7][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substrings.remove_repeats(table, length).collect()), key=repr) == plain_removal(rows, length)


def test_removal_on_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=repr) == plain_removal(rows, 20)


def test_removal_edges(spark, edge, nothing):
    got = substrings.remove_repeats(edge, keep_text=True).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == by[10].n_words and by[10].kept == "" and by[5].n_words == by[10].n_words
    # Rows of one id and text are one document; a row without words keeps nothing.
    assert [r.n_removed for r in got if r.doc_id == 6] == [0, 0] and by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert substrings.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(edge, 10)


def test_removal_shuffles_texts_once(docs):
    import contextlib
    import io

    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        substrings.remove_repeats(docs).explain("formatted")
    dealt = said.getvalue().partition("\n\n")[0]
    assert dealt.count("ReusedExchange") >= 2 or dealt.count("REPARTITION") <= 1


# ---- tiling ----

def plain_tiling(text, item, tile):
    a, b = (tiling.WORD.findall(t.lower()) for t in (text, item))
    used_a, used_b, covered, tiles = [False] * len(a), [False] * len(b), 0, 0
    while True:
        best = None
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and not used_a[p + n] and not used_b[q + n]:
                    n += 1
                if n >= tile and (best is None or (-n, p, q) < best):
                    best = (-n, p, q)
        if best is None:
            return covered, tiles
        n, p, q = -best[0], best[1], best[2]
        used_a[p : p + n], used_b[q : q + n] = [True] * n, [True] * n
        covered, tiles = covered + n, tiles + 1


def test_tiling_equals_brute_force():
    draw = random.Random(4)
    for _ in range(600):
        a, b = (" ".join(draw.choice("abcdef") for _ in range(draw.randint(0, n))) for n in (30, 9))
        covered, tiles = plain_tiling(a, b, 3)
        found = tiling.Index([b], 3).leaks(a, 0.5)
        size = len(b.split())
        assert [(k.covered, k.tiles) for k in found] == ([(covered, tiles)] if covered and covered >= 0.5 * size else [])


def test_reordered_passages_are_caught(spark):
    words = [f"q{i}" for i in range(40)]
    moved = words[20:40] + ["x"] + words[0:20]
    table = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(words[:12])), (3, " ".join(words[::-1])), (4, None), (5, "zz " + " ".join(words)), (None, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words)), (8, None), (9, ""), (10, "q1 q2")], "item_id long, text string")
    got = tiling.leaks(table, items)
    assert {(r.doc_id, r.item_id, round(r.coverage, 3), r.tiles) for r in got.where("item_id = 7").collect()} == {(1, 7, 1.0, 2), (5, 7, 1.0, 1), (None, 7, 1.0, 1)}
    assert {(r.doc_id, r.item_id, r.coverage, r.tiles) for r in got.where("item_id <> 7").collect()} == {(i, 10, 1.0, 1) for i in (1, 2, 5, None)}  # not null or empty ones
    blocks = tiling.leaks(table, items, block_chars=60)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))
    clean = tiling.drop_leaked(table, items, block_chars=60)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4]  # 2 holds the two-word item


def test_tiling_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "the same text again and again")], "item_id long, text string")
    assert sorted(r.doc_id for r in tiling.leaks(edge, items).collect()) == [6, 6, 7]
    assert tiling.drop_leaked(edge, items).count() == edge.count() - 3
    empty = items.limit(0)
    assert tiling.leaks(edge, empty).count() == 0 and tiling.drop_leaked(edge, empty).count() == edge.count() and tiling.leaks(nothing, items).count() == 0


# ---- the pipeline ----

def test_stages_run_on_edges(spark, edge, nothing, tmp_path):
    columns = edge.columns
    benchmark = spark.createDataFrame([(1, "some words that nobody has written")], "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (edge, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert out.columns[: len(columns)] == columns, name
            assert out.count() <= table.count()
            assert k < 4 and len(out.columns) == len(columns) or k == 4


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    items = [" ".join(tiling.WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").collect()}
    assert not bad & set(out)
    lines = {i: f" {' '.join(tiling.WORD.findall(t.lower()))} " for i, t in docs.items()}
    leaked = {i for i, line in lines.items() if any(f" {item} " in line for item in items)}
    assert not leaked & set(out)
    assert len({docs[i].lower() for i in out}) == len(out)
    sets = {i: shingles(docs[i]) for i in out}
    ids = sorted(out)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for r in out.values():
        assert r.decoded == r.text and "@mail" not in r.text and r.n_chars == len(r.text)
    assert len(out) > 0.6 * len(docs)
