"""Benchmark decontamination by greedy string tiling.

Texts are compared word by word (runs of word characters, lower case; single characters in scripts without spaces). Runs of ``tile`` words that a document shares with a benchmark
item are found by rolling (Karp-Rabin) hashes and joined on them; seeds on one diagonal grow to maximal matches. Then, again and
again, the longest match that is still free is marked in both texts, and what a mark cuts goes back as shorter matches, until
no free match of ``tile`` words is left. An item is leaked if the marked tiles cover ``coverage`` of its
words; their order does not matter, so rearranged passages count as well.

The benchmark is read in blocks of bounded size, each sent to the tasks as an index; documents are scanned where they lie, once per block,
and nothing is shuffled. Of an item of fewer than ``tile`` words the seed is all of its words, so it is found where they stand in a row.
Items without a word (null and empty ones among them) are never found. Items that repeat count once; null and empty documents hold nothing.
Documents that repeat are tested one by one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.llm.common import blank, read_table, slices, texts

TILE = 5
COVERAGE = 0.6
BLOCK_CHARS = 4_000_000
FACTOR = 0x9E3779B97F4A7C15
#: Thai, Lao, Myanmar, Khmer, kana and Han are written without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?!\W)[{UNSPACED}]")


class Leak(NamedTuple):
    item: int
    coverage: float
    covered: int
    tiles: int
    longest: int


class Seeds(NamedTuple):
    """Rolling hashes of the items' runs, sorted, and the (item, place) pairs of each."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    places: np.ndarray


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of each run of ``length`` numbers."""
    n = len(numbers) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        values = numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        for i in range(length):
            total = total * np.uint64(FACTOR) + values[i : i + n]
    return total


class Index:
    """Words, item lengths and seeds of a block of benchmark items."""

    def __init__(self, items: Sequence[str], tile: int = TILE):
        words = [WORD.findall(t.lower()) for t in items]
        self.tile = tile
        self.numbers: dict[str, int] = {}
        for w in {w for ws in words for w in ws}:
            self.numbers[w] = len(self.numbers) + 1
        self.coded = [np.array([self.numbers[w] for w in ws], np.int64) for ws in words]
        self.sizes = np.array([len(c) for c in self.coded], np.int64)
        #: Seeds by their length: ``tile`` words, and the whole of items that have fewer.
        self.seeds = {n: self.seeds_of(n) for n in sorted({min(s, tile) for s in self.sizes.tolist()} - {0}, reverse=True)}

    def seeds_of(self, length: int) -> Seeds:
        hashes = [rolling(c, length) if min(len(c), self.tile) == length else np.zeros(0, np.uint64) for c in self.coded]
        owner = np.repeat(np.arange(len(hashes)), np.array([len(h) for h in hashes], np.int64))
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.lexsort((place, owner, flat))
        unique, first = np.unique(flat[order], return_index=True)
        return Seeds(unique, np.append(first, len(flat)), owner[order], place[order])

    def leaks(self, text: str, coverage: float) -> list[Leak]:
        """Items of which tiles of the text cover the given share, by number."""
        look = self.numbers.get
        numbers = np.fromiter((look(w, 0) for w in WORD.findall(text.lower())), np.int64)
        return [leak for length, seeds in self.seeds.items() for leak in self.found(numbers, length, seeds, coverage)]

    def found(self, numbers: np.ndarray, tile: int, seeds: Seeds, coverage: float) -> list[Leak]:
        """Leaks among the items whose seeds have ``tile`` words."""
        if len(numbers) < tile:
            return []
        # A run with a word that no item has is no seed.
        gaps = np.concatenate([[0], np.cumsum(numbers == 0)])
        at = np.flatnonzero(gaps[tile:] == gaps[:-tile])
        hashes = rolling(numbers, tile)[at]
        slot = np.minimum(np.searchsorted(seeds.hashes, hashes), len(seeds.hashes) - 1)
        hit = seeds.hashes[slot] == hashes
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        count = seeds.first[slot + 1] - seeds.first[slot]
        pick = np.arange(count.sum()) + np.repeat(seeds.first[slot] - np.cumsum(count) + count, count)
        item, there, here = seeds.items[pick], seeds.places[pick], np.repeat(at, count)
        order = np.argsort(item, kind="stable")
        item, there, here = item[order], there[order], here[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        parts = zip(item[np.concatenate([[0], cuts])].tolist(), np.split(here, cuts), np.split(there, cuts))
        found = (self.tiled(numbers, tile, i, p, q, coverage) for i, p, q in parts)
        return [leak for leak in found if leak]

    def tiled(self, numbers: np.ndarray, length: int, item: int, here: np.ndarray, there: np.ndarray, coverage: float) -> Leak | None:
        size = int(self.sizes[item])
        reach = np.zeros(size + 1, np.int64)
        np.add.at(reach, there, 1)
        np.add.at(reach, there + length, -1)
        if np.count_nonzero(np.cumsum(reach)[:-1]) < coverage * size:
            return None
        order = np.lexsort((here, here - there))
        here, there = here[order], there[order]
        breaks = np.flatnonzero((np.diff(here) != 1) | (np.diff(there) != 1)) + 1
        starts = np.concatenate([[0], breaks])
        spans = np.diff(np.append(starts, len(here))) + length - 1
        heap = []
        for s, n in zip(starts.tolist(), spans.tolist()):
            p, q = int(here[s]), int(there[s])
            # Equal hashes are checked word by word: a match is where the words are the same.
            for a, b in free_runs(numbers[p : p + n] != self.coded[item][q : q + n], length):
                heap.append((-(b - a), p + a, q + a))
        heapq.heapify(heap)
        own = np.zeros(size, bool)
        used: set[int] = set()
        covered = tiles = longest = 0
        while heap and covered < size:
            n, p, q = heapq.heappop(heap)
            n = -n
            blocked = own[q : q + n] | np.fromiter((k in used for k in range(p, p + n)), bool, n)
            if blocked.any():
                for a, b in free_runs(blocked, length):
                    heapq.heappush(heap, (-(b - a), p + a, q + a))
                continue
            own[q : q + n] = True
            used.update(range(p, p + n))
            covered, tiles, longest = covered + n, tiles + 1, max(longest, n)
        return Leak(item, covered / size, covered, tiles, longest) if covered >= coverage * size else None


def free_runs(blocked: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` places that are not blocked."""
    edges = np.flatnonzero(np.diff(np.concatenate([[1], blocked.astype(np.int8), [1]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[Any, str]]]:
    """The benchmark's distinct items in blocks of about ``block_chars`` characters, one after another."""
    items = benchmark.select(F.col(id_col).alias("i"), blank(text_col).alias("t")).where(F.length("t") > 0).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    number = -(-total // block_chars)
    for b in range(number):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(number)) == b)
        if found := [(r.i, r.t) for r in part.collect()]:
            yield sorted(found, key=repr)


def sent(spark: SparkSession, block: list[tuple[Any, str]], tile: int) -> Callable[[], Index]:
    """The block's index in tasks; its size is bounded by the block's."""
    value = spark.sparkContext.broadcast(Index([t for _, t in block], tile))
    return lambda: value.value


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    tile: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and leaked item: (id, item, coverage, covered words, tiles, longest tile)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, coverage double, covered_words int, tiles int, longest_tile int"
    spark = docs.sparkSession
    rows = docs.select(id_col, blank(text_col).alias("_text"))
    parts = []
    for block in blocks(benchmark, item_col, "text", block_chars):
        index, ids = sent(spark, block, tile), pa.array([i for i, _ in block])

        def run(batches: Iterator[pa.RecordBatch], index=index, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [(n, leak) for n, t in enumerate(texts(batch, "_text")) for leak in index().leaks(t, coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(id_col).take(pa.array([n for n, _ in found])), ids.take(pa.array([k.item for _, k in found])),
                        pa.array([k.coverage for _, k in found], pa.float64()),
                        *(pa.array([k[f] for _, k in found], pa.int32()) for f in (2, 3, 4)),
                    ], names=[id_col, item_col, "coverage", "covered_words", "tiles", "longest_tile"])

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_leaked(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows whose text leaks no item, with all their columns."""
    at, schema = docs.columns.index(text_col), docs.schema
    for block in blocks(benchmark, block_chars=block_chars):
        index = sent(docs.sparkSession, block, tile)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                raw = batch.column(at).cast(pa.string()).to_pylist()
                yield batch.filter(pa.array([not index().leaks(t or "", coverage) for t in raw], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked benchmark item of every document."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_leaks": op8_benchmark_leaks}
ORACLES: dict[str, str] = {}
