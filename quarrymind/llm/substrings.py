"""Removal of repeated passages by level-wise doubling.

A passage is ``length`` consecutive words. It repeats only if its halves do, and these only if their halves do; so short windows come
first, and only those that repeat are extended to twice their length. Three levels are used: a quarter, half and all of ``length``. At the
first level a window is looked at if its hash is the smallest among the short windows of some passage, so equal passages choose equal windows and
about one in eight has to be moved. A passage stays a candidate if the longer windows around its chosen one repeat. At the last level
each document gives its distinct candidate passages; those seen in an earlier document, or earlier in the same one, are removed.
Lengths beyond ``length`` add nothing, since longer repeats are made of passages, so no further level is needed.

Copies of a whole text take part once, by their first document; every later copy consists of removed passages alone. Counts of windows are combined before
they are shuffled, and joins on windows are inner or semi joins that adaptive execution can split, so a frequent
window does not gather in one task. Texts are shuffled once, packed, and the exchange is used again at each level.

Documents are ordered by id (whole numbers; nulls last), and by a hash of their text where ids repeat. Rows of the same id and text are one document,
of which each row gets the result. Null texts and texts shorter than ``length`` keep all words. Hashes of passages have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from quarrymind.llm.common import blank, cut_lineage, read_table, slices, utf8

LENGTH = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1


# ---- windows of one text ----

def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` word hashes; the last step spreads it over all bits."""
    n = len(values) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(length):
            total = total * FACTOR + values[i : i + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def chosen(short: np.ndarray, length: int) -> np.ndarray:
    """For each passage, the place of its chosen short window: the first of the smallest hashes."""
    inside = length - length // 4 + 1
    out = np.empty(len(short) - inside + 1, np.int64)
    for at in range(0, len(out), 1 << 16):
        part = sliding_window_view(short[at : at + (1 << 16) + inside - 1], inside)
        out[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return out


def half_starts(places: np.ndarray, words: int, length: int) -> np.ndarray:
    """Starts of the windows of half the length that begin or end with the chosen ones."""
    quarter, half = length // 4, length // 2
    starts = np.unique(np.concatenate([places, places - (half - quarter)]))
    return starts[(starts >= 0) & (starts + half <= words)]


def candidates(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Starts of the passages whose windows of half the length, as far as they lie inside, are among ``starts``."""
    quarter, half = length // 4, length // 2
    at = chosen(window_hashes(values, quarter), length)
    first = np.arange(len(at))
    offset = at - first
    repeated = np.zeros(len(values) + 1, bool)
    repeated[starts] = True
    back = half - quarter
    right = repeated[at] | (offset > length - half)
    left = repeated[np.maximum(at - back, 0)] & (at >= back) | (offset < back)
    return first[right & left]


def keep_mask(words: int, values: np.ndarray, elsewhere: set[int], again: set[int], length: int) -> np.ndarray:
    """Which words no removed passage covers."""
    hashes = window_hashes(values, length).view(np.int64)
    known = np.isin(hashes, np.fromiter(elsewhere, np.int64, len(elsewhere)))
    if again:
        inner = np.flatnonzero(np.isin(hashes, np.fromiter(again, np.int64, len(again))))
        _, first = np.unique(hashes[inner], return_index=True)
        later = np.ones(len(inner), bool)
        later[first] = False
        known[inner[later]] = True
    cover = np.zeros(words + 1, np.int64)
    starts = np.flatnonzero(known)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    return np.cumsum(cover[:-1]) == 0


# ---- the levels ----

def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, id, text): ``place`` orders the documents, and rows of one place are one document."""
    rows = docs.select(F.col(id_col).alias("id"), blank(text_col).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    repeated = rows.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        return rows
    # Ids that repeat: number the distinct (id, text) in order, which costs one more copy of the texts.
    rows = rows.withColumn("key", F.xxhash64("text"))
    order = [F.col("place"), F.col("key")]
    numbered = rows.select("place", "key").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(numbered.withColumn("number", F.monotonically_increasing_id()), "places")
    return cut_lineage(rows.join(numbered, ["place", "key"]).select(F.col("number").alias("place"), "id", "text"), "placed")


def short_windows(rows: DataFrame, length: int, counted: bool) -> DataFrame:
    """Chosen windows of the first level: (h, x) to be counted, where ``x`` is the same for the same place in copies, or (h, place, at)."""
    schema = "h long, x long" if counted else "h long, place long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, more, sizes = [], [], []
            for text in utf8(batch):
                words = text.split()
                if len(words) < length:
                    sizes.append(0)
                    continue
                short = window_hashes(word_hashes(words), length // 4)
                at = np.unique(chosen(short, length))
                hashes.append(short[at])
                sizes.append(len(at))
                if counted:
                    content = np.uint64(xxh3_128_intdigest(text) % (2**64))
                    x = (content ^ at.astype(np.uint64)) * FACTOR
                    more.append(x ^ (x >> np.uint64(29)))
                else:
                    more.append(at)
            if not hashes:
                continue
            h = pa.array(np.concatenate(hashes).view(np.int64))
            if counted:
                yield pa.RecordBatch.from_arrays([h, pa.array(np.concatenate(more).view(np.int64))], names=["h", "x"])
            else:
                place = np.repeat(batch.column("place").to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([h, pa.array(place), pa.array(np.concatenate(more).astype(np.int32))], names=["h", "place", "at"])

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame) -> DataFrame:
    """(place, id, packed text), dealt by place."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            small = pa.array([squeeze.compress(t) for t in utf8(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("id"), small], names=["place", "id", "packed"])

    return rows.select("place", "id", "text").mapInArrow(run, f"place long, id {kind}, packed binary").repartition("place")


def unpacked(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of each text; sizes are in the packed frames."""
    open_up = zstandard.ZstdDecompressor()
    for data in batch.column("packed").to_pylist():
        yield open_up.decompress(data).split()


def half_windows(rows: DataFrame, length: int) -> DataFrame:
    """(h, place, at) of the windows of half the length around the places ``ats`` of repeated short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            hashes, at = [], []
            for words, ats in zip(unpacked(batch), batch.column("ats")):
                starts = half_starts(np.unique(ats.values.to_numpy()).astype(np.int64), len(words), length)
                hashes.append(window_hashes(word_hashes(words), length // 2)[starts])
                at.append(starts)
            place = np.repeat(batch.column("place").to_numpy(zero_copy_only=False), list(map(len, at)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(hashes).view(np.int64)), pa.array(place), pa.array(np.concatenate(at).astype(np.int32))
            ], names=["h", "place", "at"])

    return rows.select("place", "packed", "ats").mapInArrow(run, "h long, place long, at int")


def passages(rows: DataFrame, length: int) -> DataFrame:
    """(h, place, again): the distinct candidate passages of each document, and whether it holds one more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            hashes, again = [], []
            for words, ats in zip(unpacked(batch), batch.column("ats")):
                values = word_hashes(words)
                starts = candidates(values, ats.values.to_numpy().astype(np.int64), length)
                distinct, count = np.unique(window_hashes(values, length)[starts], return_counts=True)
                hashes.append(distinct)
                again.append(count > 1)
            place = np.repeat(batch.column("place").to_numpy(zero_copy_only=False), list(map(len, again)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(hashes).view(np.int64)), pa.array(place), pa.array(np.concatenate(again))
            ], names=["h", "place", "again"])

    return rows.select("place", "packed", "ats").mapInArrow(run, "h long, place long, again boolean")


def first_copies(rows: DataFrame) -> DataFrame:
    """(place, copy): whether an earlier document has exactly the same text. Only hashes are moved."""
    each = cut_lineage(rows.select("place", F.md5("text").alias("whole")), "contents")
    key = F.reverse("whole").alias("key")  # another key than the groups', as for windows below
    first = each.groupBy("whole").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("last > first").select(key, "first")
    later = each.select(key, "place").join(first, "key").where("place > first")
    return later.select("place").distinct().withColumn("copy", F.lit(True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, and with ``keep_text`` the kept words joined by spaces. ``length`` is a multiple of four."""
    if length < 4 or length % 4:
        raise ValueError("length has to be a multiple of four")
    rows = placed(docs, id_col, text_col)
    copies = cut_lineage(first_copies(rows), "copies")
    seen = short_windows(rows, length, True).groupBy("h").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    repeated = cut_lineage(seen.where("most <> least").select("h"), "short-repeats")
    quarter = short_windows(rows, length, False).join(repeated, "h", "left_semi").select("place", "at")
    ats = quarter.groupBy("place").agg(F.collect_list("at").alias("ats")).join(copies, "place", "left_anti")
    ats = cut_lineage(ats, "short-places")
    # From here on one plan, so that the packed texts are dealt out once for all levels.
    store = packed(rows)
    halves = half_windows(store.join(ats, "place"), length)
    # Joined by another key than the counts were grouped by, so that both sides are dealt for the join alone: then adaptive
    # execution can split the rows of a frequent window.
    key = F.bitwise_not("h").alias("key")
    twice = halves.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(key)
    starts = halves.select(key, "place", "at").join(twice, "key", "left_semi").groupBy("place").agg(F.collect_list("at").alias("ats"))
    whole = passages(store.join(starts, "place"), length)
    first = whole.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("last > first").select(key, "first")
    marks = whole.select(key, "place", "again").join(first, "key", "left").select(
        F.bitwise_not("key").alias("h"), "place", "again", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("elsewhere")
    )
    found = marks.where("elsewhere or again").groupBy("place").agg(
        F.collect_list(F.when(F.col("elsewhere"), F.col("h"))).alias("elsewhere"), F.collect_list(F.when(F.col("again"), F.col("h"))).alias("again"),
    )
    judged = store.join(found, "place", "left").join(copies, "place", "left")
    kind = store.schema["id"].dataType.simpleString()
    extra = ", kept string" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[list] = [[], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("elsewhere", "again", "copy"))
            for words, elsewhere, again, copy in zip(unpacked(batch), *columns):
                n = len(words)
                if copy and n >= length:
                    kept = []
                elif elsewhere or again:
                    mask = keep_mask(n, word_hashes(words), set(elsewhere), set(again), length)
                    kept = [w for w, k in zip(words, mask) if k]
                else:
                    kept = words
                line = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(line).hexdigest(), line)):
                    column.append(value)
            arrays = [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array(out[3], pa.binary()).cast(pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = judged.select("id", "packed", "elsewhere", "again", "copy")
    return columns.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string{extra}")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words that occur earlier."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_repeated_passages": op5_repeated_passages}
ORACLES = {"op5_repeated_passages": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
passage as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (select doc_id, i from passage qualify row_number() over (partition by k order by doc_id, i) > 1),
covered as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as line from words anti join covered using (doc_id, p) group by 1)
select d.doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(line, '')) as kept_sha256
from d left join kept using (doc_id)"""}
