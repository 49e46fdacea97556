"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit ``i`` is set if it is set in more than half of the (weighted) hashes of a text's shingles. Two
fingerprints link if at most ``radius`` bits differ. To find links, the bits are grouped into parts, correlated bits together, and each
part ``p`` gets a threshold ``t_p`` (-1: not looked at) so that the sum of ``t_p + 1`` is ``radius + 1``: by the pigeonhole principle linked
fingerprints differ in at most ``t_p`` bits of some part. Number of parts and thresholds minimise, by dynamic programming,
the expected cost of key rows and candidates, estimated from the bits' joint counts over all fingerprints.

Each distinct fingerprint is stored under its value of each part and looked up under all values within the part's threshold. Rows that share
a key are compared in place and give a spanning forest of their links, never all pairs; a key with more than ``BUCKET`` rows
is dealt out in pairs of blocks that together compare all of its rows. Components of the links are found by star rounds.

:func:`near_duplicates` groups texts whose sets of word 5-shingles are similar by 0.8 or more. Links of their fingerprints, found as above,
propose pairs first, and whole shingle sets decide. What fingerprints miss comes from bands: texts that share one of ``BANDS`` bands of
``BAND_ROWS`` minima of their shingle hashes are compared where the band's rows lie: four bits of each minimum tell which pairs can be similar (they
rule out those that are far from it, by ``SLACK``), and whole shingle sets decide. First each text meets the likeliest other one of
each band; then every two of a band that similar pairs leave unconnected are compared in place, and only the pairs that connect
them are handed on. So no step has more rows than texts have bands. The chance to miss a pair depends on its similarity alone, not on the
kind of edit or on other texts.

Null texts count as empty. Texts without words have fingerprint zero and are linked like any others. Repeated rows are copies.
A null id is never the smallest of a component that has another. Further columns are ignored, or kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from quarrymind.llm.common import blank, cut_lineage, read_table, slices, utf8
from quarrymind.llm.components import components
from quarrymind.session import scratch, scratch_path

BITS = 64
SEED = 42
RADIUS = 3
BUCKET = 4096
#: Rows with whole shingle sets that are compared in one task.
SETS = 512
FEW = 12
SLACK = 0.2
BANDS, BAND_ROWS = 32, 5
KEY_BITS = 48
#: The largest Bloom filter of keys, in bits; it goes to all tasks.
FILTER_BITS = 1 << 24


# ---- fingerprints ----

def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lowered."""
    return text.lower().split()


def shingle_hashes(words: Sequence[bytes], length: int) -> np.ndarray:
    """XXH64 of each run of ``length`` words joined by spaces, repeats included; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[length - 1 :] or ends[-1:])), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: bits that are set in more than half of them."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Independent hashes for a further fingerprint (a finaliser of two multiplications)."""
    x = hashes + np.uint64((table * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(values: Sequence[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, over shingles with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [majority(shingle_hashes(words_of(t), shingle)) for t in utf8(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), signed(prints)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, blank(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


# ---- partitions and thresholds ----

class Part(NamedTuple):
    bits: tuple[int, ...]
    threshold: int


def bit_counts(prints: DataFrame, tables: int = 1) -> tuple[int, np.ndarray]:
    """Number of rows of ``fps``, and for each table how often two bits are both set; summed in the tasks, 64 x 64 numbers a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((tables, BITS, BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column("fps").slice(at, 4096).flatten().to_numpy(zero_copy_only=False).reshape(-1, tables)
                rows += len(part)
                for t in range(tables):
                    bits = np.unpackbits(np.ascontiguousarray(part[:, t]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                    total[t] += bits.T @ bits
        if rows:
            place = np.arange(total.size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total.reshape(-1), rows).astype(np.int64))], names=["place", "n"])

    sums = prints.select("fps").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(tables * BITS * BITS + 1)
    for row in sums:
        flat[row.place] = row.n
    return int(flat[-1]), flat[:-1].reshape(tables, BITS, BITS)


def group_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Parts of (nearly) equal width; each starts with the bit most correlated to those left and takes the bits most correlated to it."""
    left, out = set(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        rest = sorted(left)
        first = max(rest, key=lambda b: (correlation[b, rest].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < width:
            rest = sorted(left)
            best = max(rest, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(tuple(group))
    return out


def within(bits: Sequence[int], equal: np.ndarray, both_equal: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0 ... ``most`` of the bits, as a chain in which each bit depends on the one before."""
    odds = np.zeros((2, most + 2))  # by whether the last bit is equal, and by differing bits so far
    odds[1, 0], odds[0, 1] = equal[bits[0]], 1 - equal[bits[0]]
    for a, b in zip(bits, bits[1:]):
        stay = both_equal[a, b] / equal[a]
        lost = (equal[b] - both_equal[a, b]) / max(1 - equal[a], 1e-12)
        after = np.zeros_like(odds)
        after[1] = odds[1] * stay + odds[0] * min(max(lost, 0.0), 1.0)
        differ = odds[1] * (1 - stay) + odds[0] * (1 - min(max(lost, 0.0), 1.0))
        after[0, 1:] = differ[:-1]
        odds = after
    return np.cumsum(odds.sum(axis=0))[: most + 1]


def plan(rows: int, both: np.ndarray, radius: int, row_cost: float = 200.0) -> list[Part]:
    """Parts with thresholds of the least estimated cost: ``row_cost`` for each key row and one for each candidate."""
    n = max(rows, 2)
    one = np.clip(np.diag(both) / n, 1e-6, 1 - 1e-6)
    p11 = both / n
    p10 = one[:, None] - p11
    p01, p00 = p10.T, 1 - one[:, None] - one[None, :] + p11
    equal = one**2 + (1 - one) ** 2
    both_equal = p11**2 + p10**2 + p01**2 + p00**2
    spread = np.sqrt(one * (1 - one))
    correlation = np.abs((p11 - np.outer(one, one)) / np.outer(spread, spread))
    units, best = radius + 1, (np.inf, [])
    for number in range(max(2, -(-BITS // KEY_BITS)), max(units, 2) + 1):
        groups = group_bits(correlation, number)
        costs = []
        for bits in groups:
            share = within(bits, equal, both_equal, radius)
            costs.append([0.0] + [
                row_cost * n * sum(comb(len(bits), d) for d in range(u)) + n * n / 2 * share[u - 1] for u in range(1, units + 1)
            ])
        # Least cost of the parts so far, by the units given out, and how they were given.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for given, (spent, shares) in table.items():
                for k in range(units - given + 1):
                    if given + k not in after or spent + cost[k] < after[given + k][0]:
                        after[given + k] = (spent + cost[k], [*shares, k])
            table = after
        if table[units][0] < best[0]:
            best = (table[units][0], [Part(bits, k - 1) for bits, k in zip(groups, table[units][1])])
    return [p for p in best[1] if p.threshold >= 0]


# ---- keys, probes and links ----

def part_values(prints: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def flips(width: int, most: int) -> np.ndarray:
    """All changes of at most ``most`` of ``width`` bits, the empty one first."""
    return np.array([sum(1 << b for b in c) for d in range(most + 1) for c in combinations(range(width), d)], np.uint64)


def key_rows(nodes: DataFrame, plans: list[list[Part]]) -> DataFrame:
    """(bucket, node, fp, probe): each node under its own part values, and as a probe under the values near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            node = batch.column("node").to_numpy(zero_copy_only=False)
            prints = batch.column("fps").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, len(plans))
            number = 0
            for t, parts in enumerate(plans):
                for part in parts:
                    value = part_values(prints[:, t], part.bits)
                    for i, flip in enumerate(flips(len(part.bits), part.threshold)):
                        bucket = (value ^ flip) | np.uint64(number << KEY_BITS)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(bucket.view(np.int64)), pa.array(node), pa.array(np.ascontiguousarray(prints[:, t]).view(np.int64)),
                            pa.array(np.full(len(node), i > 0)),
                        ], names=["bucket", "node", "fp", "probe"])
                    number += 1

    return nodes.mapInArrow(run, "bucket long, node long, fp long, probe boolean")


def forest(node: np.ndarray, prints: np.ndarray, probe: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among rows of one key: each row is reached once, from a row it links to."""
    left, ones, others = np.arange(len(node)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            if probe[at]:
                near &= ~probe[left]
            found, left = left[near], left[~near]
            if len(found):
                queue.extend(found.tolist())
                ones.append(np.full(len(found), node[at]))
                others.append(node[found])
    return ones, others


def linked(keys: np.ndarray, node: np.ndarray, prints: np.ndarray, probe: np.ndarray, radius: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: all of a short run, by shifted comparison; a forest of those of a long one."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff(np.append(starts, len(keys)))
    of = np.repeat(size, size)
    ones, others = [], []
    for d in range(1, few):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & (of[d:] <= few))
        close = np.bitwise_count(prints[same] ^ prints[same + d]) <= radius
        close &= ~(probe[same] & probe[same + d])
        ones.append(node[same[close]])
        others.append(node[same[close] + d])
    for s, n in zip(starts[size > few].tolist(), size[size > few].tolist()):
        a, b = forest(node[s : s + n], prints[s : s + n], probe[s : s + n], radius)
        ones += a
        others += b
    a, b = np.concatenate(ones), np.concatenate(others)
    return a[a != b], b[a != b]


def links(nodes: DataFrame, radius: int = RADIUS, tables: int = 1) -> DataFrame:
    """Links (a, b) that connect every two of the ``nodes`` (node, fps) of which some fingerprints differ in at most ``radius`` bits:
    not each such pair, but paths of such pairs between them. Rows of a key are taken in a fixed order, so a rerun gives the same links."""
    count, both = bit_counts(nodes, tables)
    if not count:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    rows = key_rows(nodes, [plan(count, b, radius) for b in both])
    large = cut_lineage(rows.groupBy("bucket").count().where(F.col("count") > BUCKET), "large-keys")
    # Rows of a large key are dealt into blocks, and each two blocks meet once.
    number = F.ceil(F.col("count") / BUCKET).cast("int")
    block = F.pmod(F.xxhash64("node"), number).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), number - 1), lambda j: F.least(block, j) * number + F.greatest(block, j))
    dealt = rows.join(large, "bucket", "left").select(
        "bucket", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1))).otherwise(meetings)).alias("meeting"), "node", "fp", "probe"
    ).repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting", "probe", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(parts: list[np.ndarray], end: int) -> pa.RecordBatch:
            key = np.cumsum(np.concatenate([[0], (np.diff(parts[0][:end]) != 0) | (np.diff(parts[1][:end]) != 0)]))
            a, b = linked(key, parts[2][:end], parts[3][:end].view(np.uint64), parts[4][:end], radius)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "meeting", "node", "fp", "probe")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield found(held, end)
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield found(held, len(held[0]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_print_components(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) of (id, fp): the component is named by the smallest id that is reachable over links."""
    prints = cut_lineage(prints, "fingerprints")
    first = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    nodes = first.select(F.col("fp").alias("node"), F.array("fp").alias("fps"))
    roots = components(links(nodes, radius))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = cut_lineage(rooted, "roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# ---- near-duplicates of texts ----

def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of shingle hashes under each of ``BANDS * BAND_ROWS`` permutations of 32-bit numbers."""
    times = (mixed(np.arange(BANDS * BAND_ROWS, dtype=np.uint64), 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(times), 2**32 - 1, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(out, (times[:, None] * short[None, at : at + 512]).min(axis=1), out=out)
    return out


def bands_of(least: np.ndarray) -> np.ndarray:
    """One key for each band of the minima of each text; bands of different numbers have different keys."""
    parts = least.astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for row in range(BAND_ROWS):
        out = mixed(out ^ parts[:, :, row], row + 1)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen minima in a number: (texts, minima / 16)."""
    bits = (mixed(least.astype(np.uint64), 0) >> np.uint64(60)).reshape(len(least), -1, 16)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 4, dtype=np.uint64), axis=2)


def likeness(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of some signatures to each of the others: the share of equal minima, less what equal bits come by chance."""
    differ = np.zeros((len(some), len(others)), np.int32)
    for place in range(some.shape[1]):
        x = some[:, None, place] ^ others[None, :, place]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
    return 1 - differ.astype(np.float32) * np.float32(16 / 15 / 16 / some.shape[1])


def marks_of(rows: dict) -> np.ndarray:
    return np.frombuffer(b"".join(rows["bytes"]), "<u8").reshape(len(rows["node"]), -1)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two whole sets of 64-bit shingle hashes, ascending."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(key, id, node, fp, bands, size, bytes): ``node`` is the hash of the words, ``fp`` the fingerprint of their shingles, ``size`` the number of
    distinct ones, ``key`` tells rows of different id or text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, prints, least, sizes = [], [], [], []
            for text in utf8(batch, "_text"):
                words = words_of(text)
                nodes.append(xxh64_intdigest(b" ".join(words), SEED))
                hashes = shingle_hashes(words, shingle)
                prints.append(majority(hashes))
                hashes = np.unique(hashes)
                least.append(minima(hashes))
                sizes.append(len(hashes))
            if not nodes:
                continue
            least = np.array(least)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), signed(bands_of(least).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_id"), signed(nodes), signed(prints), lists, pa.array(sizes, pa.int32()), pa.array([r.tobytes() for r in signatures(least)], pa.binary())],
                names=["key", "id", "node", "fp", "bands", "size", "bytes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), blank(text_col).alias("_text"))
    return rows.mapInArrow(run, f"key long, id {kind}, node long, fp long, bands array<long>, size int, bytes binary")


def possibly_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` a Bloom filter of the written ``keys`` may hold, so that the others' texts are not moved to meet them.

    The filter has 16 bits a key or more, up to ``FILTER_BITS``; beyond that more rows pass in vain. It is a table of words, each
    of 64 bits, that goes to all tasks.
    """
    bits = 1 << max(10, (16 * keys.count() - 1).bit_length())
    place = F.pmod("key", F.lit(min(bits, FILTER_BITS)).cast("long"))
    one = F.lit(1).cast("long")
    held = keys.select(F.shiftright(place, 6).alias("_word"), F.call_function("shiftleft", one, (place % 64).cast("int")).alias("_bit"))
    words = held.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = rows.join(F.broadcast(words), F.shiftright(place, 6) == F.col("_word"))
    return near.where(F.getbit("_bits", (place % 64).cast("int")) == 1).select(*rows.columns)


def shingle_sets(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, set) of the texts of ``keys`` (key, node), read again from the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(words_of(t), shingle)).astype("<u8").tobytes() for t in utf8(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), blank(text_col).alias("_text"))
    found = possibly_of(rows, keys).join(keys, "key")
    return found.select("node", "_text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def in_bands(rows: DataFrame, listed: DataFrame, each: Callable[[dict[str, np.ndarray | list]], tuple[Sequence, ...]], schema: str, most: int) -> DataFrame:
    """``each`` over the rows of every band, which lie together; a band of more than ``most`` rows is dealt out in pairs of blocks that together
    hold every two of its rows. ``rows`` (band, node, size, ...) are read once; ``listed`` has the same bands and is written."""
    large = cut_lineage(listed.groupBy("band").count().where(F.col("count") > most), "large-bands")
    number = F.ceil(F.col("count") / most).cast("int")
    block = F.pmod(F.xxhash64("node"), number).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), number - 1), lambda j: F.least(block, j) * number + F.greatest(block, j))
    dealt = rows.join(large, "band", "left").select(
        *rows.columns, F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1))).otherwise(meetings)).alias("meeting")
    ).repartition("band", "meeting").sortWithinPartitions("band", "meeting", "size", "node")
    names = [part.split()[0] for part in schema.split(", ")]
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            band, meeting = (table.column(c).to_numpy() for c in ("band", "meeting"))
            cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(meeting) != 0)) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), len(band)] if last else cuts.tolist()
            found: list[list] = [[] for _ in names]
            for a, b in zip(starts, ends):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                for out, more in zip(found, each({c: part.column(c).to_pylist() if part.schema.field(c).type == pa.binary() else part.column(c).to_numpy() for c in columns})):
                    out.extend(more)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)
            rest = table.slice(ends[-1] if ends else 0)
            held[:] = [] if last else rest.combine_chunks().to_batches()

        for batch in batches:
            for piece in slices(iter([batch]), 4096):
                held.append(piece)
                yield from groups(pa.Table.from_batches(held), False)
        if held:
            yield from groups(pa.Table.from_batches(held), True)

    return dealt.mapInArrow(run, schema)


def possible(size: np.ndarray, marks: np.ndarray, a: int, b: int, least: float) -> np.ndarray:
    """Likeness of rows ``a`` to ``b`` to all rows where sizes and marks let them be similar, else -1. Rows are in ascending size."""
    sure = least - SLACK
    near = likeness(marks[a:b], marks)
    fits = np.minimum(size[a:b, None], size[None]) >= least * np.maximum(size[a:b, None], size[None])
    return np.where(fits & (near >= sure), near, -1)


def likeliest(least: float) -> Callable:
    """Each row with the one that its marks are most like, if any can be similar."""

    def each(rows: dict) -> tuple[list, list]:
        node, marks = rows["node"], marks_of(rows)
        ones, others = [], []
        for a in range(0, len(node), 64):
            near = possible(rows["size"], marks, a, a + 64, least)
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -1
            best = near.argmax(axis=1)
            has = np.flatnonzero(near[np.arange(len(near)), best] >= 0)
            ones += node[a + has].tolist()
            others += node[best[has]].tolist()
        return ones, others

    return each


def foreign(least: float) -> Callable:
    """(band, node) of rows that can be similar to a row of another root."""

    def each(rows: dict) -> tuple[list, list]:
        node, root, marks = rows["node"], rows["root"], marks_of(rows)
        if (root == root[0]).all():
            return [], []
        out = []
        for a in range(0, len(node), 64):
            near = possible(rows["size"], marks, a, a + 64, least)
            out += node[a + np.flatnonzero(((near >= 0) & (root[a : a + 64, None] != root[None])).any(axis=1))].tolist()
        return rows["band"][: len(out)].tolist(), out

    return each


def connecting(least: float) -> Callable:
    """Pairs of similar rows that connect the rows of a band, as far as they are similar; rows of one root are connected already."""

    def each(rows: dict) -> tuple[list, list]:
        node, size, marks = rows["node"], rows["size"], marks_of(rows)
        sets = [np.frombuffer(s, "<u8") for s in rows["set"]]
        _, group = np.unique(rows["root"], return_inverse=True)
        ones, others = [], []
        for at in range(0, len(node), 64):
            block = possible(size, marks, at, at + 64, least)
            for a, near in enumerate(block, at):
                # Each two are compared once, the likeliest first, as long as they are in different groups.
                left = a + 1 + np.flatnonzero((near[a + 1 :] >= 0) & (group[a + 1 :] != group[a]))
                left = left[np.argsort(-near[left], kind="stable")]
                while len(left):
                    b, left = left[0], left[1:]
                    if jaccard(sets[a], sets[b]) >= least:
                        ones.append(int(node[a]))
                        others.append(int(node[b]))
                        group[group == group[b]] = group[a]
                        left = left[group[left] != group[a]]
        return ones, others

    return each


def linked_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that the links of their fingerprints propose: the first text of each fingerprint with
    the others of it, and the first ones of linked fingerprints."""
    first = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    found = links(first.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), radius)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    across = found.join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return across.unionByName(same)


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole ``sets`` (node, set) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            x, y = ([np.frombuffer(s, "<u8") for s in batch.column(c).to_pylist()] for c in ("x", "y"))
            close = [jaccard(p, q) >= least for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    compared = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    compared = compared.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return compared.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, id, root) of every row; rows of one root are copies or near copies."""
    rows = cut_lineage(described(docs, id_col, text_col, shingle), "described")
    # Copies are one node from here on; they are combined before the shuffle.
    nodes = cut_lineage(rows.select("node", "fp", "key", "bands", "size", "bytes").dropDuplicates(["node"]), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    met = cut_lineage(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared-bands")
    shared = cut_lineage(banded.join(met, "band").select("band", "node"), "banded")

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = cut_lineage(nodes.select("key", "node").join(wanted.distinct(), "node", "left_semi"), "keys")
        return cut_lineage(shingle_sets(docs, keys, id_col, text_col, shingle), "sets")

    def similar(pairs: DataFrame, label: str) -> DataFrame:
        pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        return cut_lineage(similar_pairs(pairs, sets, least), f"similar-{label}")

    def unconnected(placed: DataFrame, stars: DataFrame) -> DataFrame:
        """(band, node, root) of the bands whose texts no path of similar pairs connects yet."""
        placed = placed.select("band", "node").join(stars, "node", "left").select("band", "node", F.coalesce("component", "node").alias("root"))
        placed = cut_lineage(placed, "rooted")
        several = cut_lineage(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band"), "mixed-bands")
        return cut_lineage(placed.join(several, "band", "left_semi"), "mixed")

    # Fingerprints propose first, then each band's likeliest pairs, then every two that share a band. A failed pair loses nothing.
    # What is connected goes on as stars, which take fewer rounds than the pairs.
    stars = components(similar(linked_prints(nodes.select("node", "fp")), "linked"))
    placed = unconnected(shared, stars)
    likely = in_bands(placed.select("band", "node").join(nodes.select("node", "size", "bytes"), "node").select("band", "node", "size", "bytes"), placed, likeliest(least), "a long, b long", BUCKET)
    stars = components(stars.union(similar(likely, "likeliest")), "node", "component")
    placed = unconnected(placed, stars)
    rooted = placed.join(nodes.select("node", "size", "bytes"), "node")
    apart = cut_lineage(in_bands(rooted, placed, foreign(least), "band long, node long", BUCKET).distinct(), "apart")
    sets = sets_of(apart.select("node"))
    left = placed.join(apart, ["band", "node"], "left_semi").join(nodes.select("node", "size", "bytes").join(sets, "node"), "node")
    left = left.select("band", "node", "size", "bytes", "root", "set")
    stars = components(stars.union(in_bands(left, apart, connecting(least), "a long, b long", SETS)), "node", "component")
    return rows.join(stars, "node", "left").select("key", "id", F.coalesce("component", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns. What is written on the way is deleted before the rows are read."""
    spark = docs.sparkSession
    path = scratch_path(spark, "chosen")
    name = "_key" + "_" * max(map(len, docs.columns))  # a name that no column has
    with scratch(spark):
        groups = near_duplicates(docs, id_col, text_col, **options)
        # Nulls come last, so a row with an id stands for its group if there is one.
        chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
        chosen.select(F.col("best.key").alias(name)).write.parquet(path)
    kept = docs.withColumn(name, row_key(id_col, text_col)).join(spark.read.schema(f"{name} long").parquet(path), name, "left_semi")
    return kept.dropDuplicates([name]).drop(name)


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_print_components(fingerprints(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_components": op1_simhash_components}
ORACLES: dict[str, str] = {}
