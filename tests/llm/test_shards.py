"""Karmarkar-Karp shards against a plain form of the rule."""

import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymind.llm import shards


def plain_differencing(weights, ways):
    """Partial partitions with their members; the two of the largest spread are combined."""
    heap = [(-w, n, [(w, [n])] + [(0, [])] * (ways - 1)) for n, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda s: -s[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], made, joined))
        made += 1
    return [load for load, _ in heap[0][2]], [set(members) for _, members in heap[0][2]]


@pytest.mark.parametrize("ways", [2, 3, 16])
@pytest.mark.parametrize("size", [1, 2, 5, 40, 300])
def test_differencing_equals_the_plain_rule(ways, size):
    draw = random.Random(size * ways)
    for most in (1, 7, 10**6, 2**50):
        weights = [draw.randint(1, most) for _ in range(size)]
        found = shards.difference(weights, ways)
        loads, members = plain_differencing(weights, ways)
        assert [sum(weights[i] for i in np.flatnonzero(found == s)) for s in range(ways)] == loads
        assert [set(np.flatnonzero(found == s).tolist()) for s in range(ways)] == members


def test_textbook_example():
    """4, 5, 6, 7, 8 in two ways: differencing ends with a difference of two."""
    found = shards.difference([8, 7, 6, 5, 4], 2)
    assert sorted(int(np.array([8, 7, 6, 5, 4])[found == s].sum()) for s in (0, 1)) == [14, 16]
    assert shards.difference([], 4).tolist() == []


def test_many_items_are_levelled():
    draw = random.Random(3)
    weights = [draw.randint(1, 10_000) for _ in range(4000)] + [600_000, 300_000, 299_999]
    found = shards.difference(weights, 16)
    loads = np.bincount(found, weights, 16)
    assert loads.max() - loads.min() <= 16


def test_items_beyond_a_fair_part_stand_alone():
    draw = random.Random(8)
    weights = [draw.randint(1, 100) for _ in range(600)] + [10**6, 4000]
    draw.shuffle(weights)
    found = np.array(shards.levelled(weights, 8))
    loads = np.bincount(found, weights, 8)
    assert max(loads) == 10**6
    rest = sorted(loads)[:-1]
    assert max(rest) - min(rest) <= 2
    assert shards.levelled([5], 4) == [0] and shards.levelled([], 4) == [] and sorted(shards.levelled([3, 3, 3], 3)) == [0, 1, 2]


def rows_of(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return shards.op13_byte_shards(spark, str(tmp_path)).collect()


def check(rows, given):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given), key=repr
    )
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    homes = {}
    for r in rows:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values()) and all(0 <= r.shard < 16 for r in rows)
    for shard in range(16):
        mine = sorted((r.slot, r.doc_id) for r in rows if r.shard == shard and r.doc_id is not None)
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
        assert [i for _, i in mine] == sorted(i for _, i in mine)


def test_shards_of_the_given_documents(spark, docs, tmp_path):
    rows = rows_of(spark, docs.repartition(5), tmp_path)
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    groups = Counter()
    for r in rows:
        groups[r.text_crc32] += r.size
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    # All groups are heavier than a share of the items here, so the whole rule is plain differencing.
    plain, _ = plain_differencing(sorted(groups.values(), reverse=True), 16)
    assert max(loads.values()) - min(loads.values()) == max(plain) - min(plain)


def test_light_groups_are_bundled(spark, monkeypatch, tmp_path):
    """A hot group of copies of a third of all bytes, and far more groups than items."""
    monkeypatch.setattr(shards, "ITEMS", 256)
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, F.repeat(F.lit("hot"), 90)).otherwise(F.repeat(F.concat(F.lit("w"), F.col("id")), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    rows = rows_of(spark, table.repartition(6), tmp_path)
    check(rows, [(r.doc_id, r.text) for r in table.collect()])
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    hot = {r.shard for r in rows if r.size == 271}
    rest = [n for s, n in loads.items() if s not in hot]
    assert len(hot) == 1 and max(rest) - min(rest) <= 8


def test_edges_and_empty_table(spark, edge, nothing, tmp_path):
    extra = edge.withColumns({c: F.lit(1) for c in ("size", "key", "shard", "slot", "n", "crc", "_heavy", "_bundle")})
    check(rows_of(spark, extra, tmp_path / "edge"), [(r.doc_id, r.text) for r in edge.collect()])
    assert rows_of(spark, nothing, tmp_path / "nothing") == []
