"""Alignment of two tokenizers over the same bytes: groups of tokens between common cuts, and how often token pairs are linked.

A text is read as a space and the text. Tokenizer A (byte-level BPE of the tokenizers library) and B (pieces of the sentencepiece library, which adds
the space itself) each cut it into runs of bytes. A's cuts are its character offsets turned into byte places; B's are the spans of its
proto. Both are coarse: tokens that share a character report the same characters, fallback bytes of a character an empty span or all of it, and the
added space is in no span. Where spans meet or overlap like that, the tokens' own decoded bytes give the exact cut. Offsets at
which tokens of both end cut the tokens into groups, and the two tokens that end there are linked.

Tokens never reach over a white-space start (:data:`CUTS`), so texts are cut there and each distinct segment is aligned once per
worker; a text's alignment is its segments' alignments one after another. This holds if no piece of B has a space or a line end
after another character, which is asked of the vocabulary; otherwise whole texts are the segments.

Texts that are null or empty, or that some token's bytes do not give back, have no tokens, groups or links; their numbers are zero.
Special tokens' strings are plain text. Repeated rows count as often as they occur. An empty table has no pairs and gives no rows.
Further columns are ignored.

The counts of pairs over all texts can be as many as the product of the vocabularies. The ``FREQUENT`` most frequent ones, a table of
proven size, go to every task; links of rarer pairs are joined with the whole table by their pair. So a frequent pair is never
shuffled by its key, and no link is left out.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Collection, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.llm.common import blank, cut_lineage, in_worker, read_table, slices, texts

FREQUENT = 1 << 16
#: Pairs are written as one number: A's id times this, and B's id.
PAIR = 1 << 32
SPACE_MARK = "▁"
#: A space or line end after a character that is no white space starts a token in both tokenizers.
CUTS = re.compile(r"(?<=\S)(?=[ \n])")
#: A line end is a token of its own, so what follows it is encoded as it is inside of a text.
GUARD = "\n"
#: Bytes of segments, tokens and groups that a worker remembers between batches, about.
REMEMBER = 128 << 20
#: Segments that go to the libraries in one line: a space and characters that are no white space.
LINE = 32
PLAIN = re.compile(r" \S+")
#: Lines that are aligned together.
AT_ONCE = 512


# ---- bytes and spans of tokens ----

def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_places(text: str) -> np.ndarray:
    """Where each character starts in UTF-8, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def exact_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, whole: int) -> np.ndarray:
    """Byte ends of tokens from their coarse spans (bytes): a cut that two neighbouring spans agree on stands, the others follow from the
    tokens' own bytes, counted from the last cut that stands. Texts may follow each other, since they end in cuts."""
    agreed = np.append(ends[:-1] == starts[1:], ends[-1:] == whole) & (ends > starts)
    own = np.cumsum(sizes)
    # Counted bytes since the last agreed cut, added to that cut.
    last = np.concatenate([[0], np.maximum.accumulate(np.where(agreed, np.arange(1, len(ends) + 1), 0))])[:-1]
    base = np.concatenate([[0], ends])[last] - np.concatenate([[0], own])[last]
    return np.where(agreed, ends, base + own)


class Alignment(NamedTuple):
    """Ids of both tokenizers, and how many tokens of each every group has; no groups if the bytes differ."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray


NOTHING = Alignment(*(np.zeros(0, np.int32) for _ in range(4)))


class Grown:
    """Rows of numbers that grow at their end, in room that is doubled when it is full."""

    def __init__(self, like: np.ndarray):
        self.room, self.size = like, len(like)

    def __len__(self) -> int:
        return self.size

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.room):
            wider = np.empty((2 * (self.size + len(rows)), *self.room.shape[1:]), self.room.dtype)
            wider[: self.size] = self.rows
            self.room = wider
        self.room[self.size : self.size + len(rows)] = rows
        self.size += len(rows)


class Aligner:
    """Aligns segments of texts; called with texts, it gives the alignment of each."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        self.b_bytes: list[bytes] = []
        cuttable = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
            cuttable &= SPACE_MARK not in piece.lstrip(SPACE_MARK) and GUARD not in piece
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [*map(len, self.a_bytes.values())]
        self.b_sizes = np.array([*map(len, self.b_bytes)], np.int64)
        self.cuts = CUTS if cuttable else re.compile(r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.held = 0
        #: Of each segment: whether its bytes differ, and where its four parts start and how long they are.
        self.bad, self.places, self.sizes = Grown(np.zeros(0, bool)), Grown(np.zeros((0, 4), np.int64)), Grown(np.zeros((0, 4), np.int64))
        self.flats = [Grown(np.zeros(0, np.int32)) for _ in range(4)]

    def line_alignments(self, lines: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Groups of segments as they stand inside of texts; the segments of a line are joined by line ends, which are tokens of their own.

        Which lines' bytes differ (their segments have no groups), the lengths of the four parts of each segment's alignment, and the parts
        of all segments, one segment after another.
        """
        wholes = [GUARD.join(line) for line in lines]
        encoded = self.a.encode_batch(wholes, add_special_tokens=False)
        # The first two pieces are the added space and the line end before the line.
        pieces = [[(p.id, p.begin, p.end) for p in proto.pieces][2:] for proto in self.b.encode([GUARD + s for s in wholes], return_type="proto")]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(a_bytes, e.ids)) == (raw := s.encode()) == b"".join([b_bytes(p[0]) for p in row]) for s, e, row in zip(wholes, encoded, pieces)]
        kept = np.flatnonzero(good).tolist()
        encoded, pieces = [encoded[k] for k in kept], [pieces[k] for k in kept]
        # All lines are one text from here on; places are bytes of it.
        places = byte_places("".join([wholes[k] for k in kept]))
        char_ends = np.cumsum([0, *(len(wholes[k]) for k in kept)])
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(kept)) for x in (encoded, pieces))
        a_ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int32)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in encoded)), np.int64).reshape(-1, 2) + np.repeat(char_ends[:-1], n_a)[:, None]
        a_ends = exact_ends(places[spans[:, 0]], places[spans[:, 1]], self.a_sizes[a_ids], int(places[-1]))
        pieces = np.fromiter(chain.from_iterable(chain.from_iterable(pieces)), np.int64).reshape(-1, 3)
        spans = pieces[:, 1:] - len(GUARD) + np.repeat(places[char_ends[:-1]], n_b)[:, None]
        b_ends = exact_ends(spans[:, 0], spans[:, 1], self.b_sizes[pieces[:, 0]], int(places[-1]))
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # Back to the segments: tokens and groups that end inside of each.
        of = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
        inside = np.array(good, bool)[of]
        n_chars = np.fromiter((len(s) for k in kept for s in lines[k]), np.int64)
        ends = np.cumsum(n_chars + 1) - 1
        ends -= np.repeat(np.arange(len(kept)), [len(lines[k]) for k in kept])  # there is no line end between lines
        first, last = places[ends - n_chars], places[ends]
        lengths, parts = np.zeros((len(of), 4), np.int64), []
        groups = [np.diff(np.searchsorted(x, common) + 1, prepend=0).astype(np.int32) for x in (a_ends, b_ends)]
        for part, (cuts, values) in enumerate(((a_ends, a_ids), (b_ends, pieces[:, 0].astype(np.int32)), (common, groups[0]), (common, groups[1]))):
            start = np.searchsorted(cuts, first, side="right")
            lengths[inside, part] = size = np.searchsorted(cuts, last, side="right") - start
            parts.append(values[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)])
        return ~np.array(good, bool), lengths, parts

    def settle(self, fresh: Collection[str]) -> None:
        """Aligns the segments that are new, plain words in lines of many, since the libraries take long over each call's start."""
        plain = [s for s in fresh if PLAIN.fullmatch(s)]
        others = [s for s in fresh if not PLAIN.fullmatch(s)]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)] + [[s] for s in others]
        while lines:
            now, lines = lines[:AT_ONCE], lines[AT_ONCE:]
            wrong, lengths, parts = self.line_alignments(now)
            # A line whose bytes differ is taken apart; a segment whose bytes differ is bad.
            again = [k for k in np.flatnonzero(wrong).tolist() if len(now[k]) > 1]
            lines += [[s] for k in again for s in now[k]]
            taken = np.ones(len(now), bool)
            taken[again] = False
            of = np.repeat(np.arange(len(now)), [len(line) for line in now])
            self.numbers |= {s: n for n, s in enumerate((s for line, mine in zip(now, taken) if mine for s in line), len(self.numbers))}
            self.bad.add(wrong[of][taken[of]])
            lengths = lengths[taken[of]]
            self.places.add(np.cumsum(lengths, axis=0) - lengths + [len(flat) for flat in self.flats])
            self.sizes.add(lengths)
            for flat, part in zip(self.flats, parts):
                flat.add(part)
        self.held += 2 * sum(map(len, fresh)) + 200 * len(fresh)

    def __call__(self, batch: Sequence[str]) -> list[Alignment]:
        if self.held + 4 * sum(map(len, self.flats)) > REMEMBER:
            self.forget()
        cut = [self.cuts.split(" " + text) if text else [] for text in batch]
        counts = [*map(len, cut)]
        self.settle(set(chain.from_iterable(cut)).difference(self.numbers))
        numbers = [*map(self.numbers.__getitem__, chain.from_iterable(cut))]
        which = np.fromiter(numbers, np.int64, len(numbers))
        bad = np.zeros(len(batch), bool)
        bad[np.repeat(np.arange(len(batch)), counts)[self.bad.rows[which]]] = True
        cuts, parts = np.cumsum([0, *counts]), []
        for flat, start, size in zip(self.flats, self.places.rows[which].T, self.sizes.rows[which].T):
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = flat.rows[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
            parts.append(np.split(ids, ends[cuts][1:-1]) if len(batch) else [])
        return [NOTHING if wrong else Alignment(*x) for wrong, *x in zip(bad, *parts)]


def aligner(a_path: str, b_path: str) -> Callable[[], Aligner]:
    name = f"aligner_{zlib.crc32(a_path.encode())}_{zlib.crc32(b_path.encode())}"
    return lambda: in_worker(name, lambda: Aligner(a_path, b_path))


# ---- tables ----

def lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if len(parts) else np.zeros(0), kind))


def distinct_links(found: Sequence[Alignment]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct pairs that are linked at the ends of each text's groups, and how often."""
    a, b, a_sizes, b_sizes = (np.concatenate([x[part] for x in found]) for part in range(4))
    pairs = a[np.cumsum(a_sizes) - 1].astype(np.int64) * PAIR + b[np.cumsum(b_sizes) - 1]
    of = np.repeat(np.arange(len(found)), [len(x.a_sizes) for x in found])
    order = np.lexsort((pairs, of))
    pairs, of = pairs[order], of[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(of), 1), bool), (np.diff(of) != 0) | (np.diff(pairs) != 0)]))
    cuts = np.searchsorted(of[first], np.arange(1, len(found)))
    return np.split(pairs[first], cuts), np.split(np.diff(np.append(first, len(of))), cuts)


#: What :func:`align` tells of each text: schema of the columns, and the columns of a batch.
Describe = tuple[str, Callable[[Sequence[Alignment]], list[pa.Array]]]

SPANS: Describe = (
    "a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>", lambda found: [lists([x[part] for x in found], pa.int32()) for part in range(4)]
)


def digest_columns(found: Sequence[Alignment]) -> list[pa.Array]:
    sha = [hashlib.sha256(line).hexdigest() if line else "" for line in group_lines(found)]
    pairs, times = distinct_links(found)
    sizes = [pa.array([len(part) for part in x], pa.int64()) for x in list(zip(*found))[:3]]
    return [*sizes, pa.array(sha, pa.string()), lists(pairs, pa.int64()), lists(times, pa.int64())]


#: Numbers of tokens and groups, digest of the groups, and the distinct linked pairs with how often they occur.
DIGESTS: Describe = ("n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, times array<bigint>", digest_columns)


def align(docs: DataFrame, make: Callable[[], Callable[[Sequence[str]], list[Alignment]]], describe: Describe = SPANS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, ...) of every row, written in the shared folder. ``row`` is unique; by default token ids of both, and how many tokens each group has."""
    schema, columns = describe
    names = [part.split()[0] for part in schema.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = make()
        for batch in slices(batches, 128):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns(together(texts(batch, "_text")))], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), blank(text_col).alias("_text")).mapInArrow(run, f"id {kind}, {schema}")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(digests: DataFrame) -> DataFrame:
    """(pair, n, best) over all rows: how many links hold the pair, and whether no pair of the same B id has more. Written."""
    each = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = cut_lineage(each.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n")), "pairs")
    b = F.pmod(F.col("pair"), F.lit(PAIR))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut_lineage(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


JOINERS = (",", "|", ";")


def group_lines(found: Sequence[Alignment]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each alignment."""
    a, b, a_sizes, b_sizes = (np.concatenate([x[part] for x in found]).astype(np.int64) for part in range(4))
    # After a token comes a comma inside of a group, a bar after A's last and a semicolon after B's last.
    a, b, a_ends, b_ends = a * 3, b * 3, np.cumsum(a_sizes), np.cumsum(b_sizes)
    a[a_ends - 1] += 1
    b[b_ends - 1] += 2
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = a
    code[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = b
    words = in_worker("token_words", list)
    for n in range(len(words), int(code.max(initial=-1)) + 1):
        words.append(f"{n // 3}{JOINERS[n % 3]}".encode())
    said, ends = [words[n] for n in code.tolist()], np.cumsum([0, *(len(x.a) + len(x.b) for x in found)]).tolist()
    return [b"".join(said[first:last])[:-1] for first, last in zip(ends, ends[1:])]


def sums(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers by key."""
    total = np.zeros(size, np.int64)
    np.add.at(total, keys, values)
    return total


def with_counts(digests: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row that :func:`align` gives with ``DIGESTS``."""
    frequent = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).orderBy("pair").toPandas()
    pair, often, best = frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = batch.num_rows
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            of = np.repeat(np.arange(rows), batch.column("pairs").value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at, now, mine = at[known], times[known], of[known]
            left = np.bincount(of[~known], minlength=rows)
            rare = [lists(np.split(x[~known], np.cumsum(left)[:-1]) if rows else [], pa.int64()) for x in (pairs, times)]
            numbers = [sums(of, times, rows), sums(mine, now * best[at], rows), sums(mine, now * often[at], rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, numbers), *rare], names=["row", "n_links", "n_best", "count_sum", "pairs", "times"])

    found = digests.select("row", "pairs", "times").mapInArrow(run, "row long, n_links long, n_best long, count_sum long, pairs array<bigint>, times array<bigint>")
    found = cut_lineage(found, "counted")
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    rare = rare.join(counts, "pair").select("row", F.lit(0).alias("n_links"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    whole = found.select("row", "n_links", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return digests.select("id", "row", "n_a", "n_b", "n_groups", "groups_sha256").join(whole, "row").select(
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of every document under the two tokenizers."""
    import public_tokenizers

    make = aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digests = align(read_table(spark, sf_dir, "documents"), make, DIGESTS)
    return with_counts(digests, pair_counts(digests)).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
