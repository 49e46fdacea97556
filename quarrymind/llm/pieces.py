"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary comes from a SentencePiece model file. Its scores are ranks of merges, so the pieces' log scores follow the
Zipf-Mandelbrot law of those ranks (``zipf=False`` takes the file's scores as they are). A text is marked (a leading
marker, spaces become markers) and cut where no piece can reach across: before a marker that follows other
characters, and around line ends, which no piece holds. Each distinct part is segmented once per worker: Viterbi runs over all new parts
at once, one trie step for all of them per character. A character without a piece costs the worst score less ten
and is encoded as its UTF-8 bytes.

Decoding joins pieces, turns byte pieces back into bytes and markers into spaces, and drops the leading one. A text
that itself holds the marker character gets spaces for it; all other texts come back unchanged.

Null and empty texts have no ids. Everything is a map over rows; further columns are ignored by :func:`encode` and kept by :func:`add_ids`.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrymind.llm.common import LATER, Remembered, blank, in_worker, read_table, runs, slices, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


# ---- the model file ----

def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> list[Piece]:
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL, **dict(fields(value))}
            out.append(Piece(piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
    return out


def zipf_scores(pieces: Sequence[Piece], shift: float = 2.7) -> list[Piece]:
    """Log probabilities by the rank of each normal piece: proportional to 1 / (rank + shift)."""
    order = sorted((i for i, p in enumerate(pieces) if p.kind == NORMAL), key=lambda i: (-pieces[i].score, i))
    whole = math.log(sum(1 / (r + shift) for r in range(1, len(order) + 1)))
    scores = {i: -math.log(r + shift) - whole for r, i in enumerate(order, 1)}
    return [p._replace(score=scores.get(i, p.score)) for i, p in enumerate(pieces)]


# ---- the trie ----

class Trie(NamedTuple):
    """Double array: the child of state ``s`` by code ``c`` is ``base[s] + c`` where ``check`` there is ``s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    codes: dict[str, int]
    longest: int


def build_trie(words: dict[str, int]) -> Trie:
    """Place the states level by level, each at the first base where all its children are free."""
    codes = {c: i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
    size = 2 * sum(map(len, words)) + 2 * len(codes) + 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    check[0] = 0
    taken[0] = 1
    level = [(0, sorted((tuple(codes[c] for c in w), n) for w, n in words.items()))]
    free = depth = 0
    while level:
        below = []
        for state, entries in level:
            children: dict[int, list] = {}
            for path, n in entries:
                if len(path) == depth:
                    value[state] = n
                else:
                    children.setdefault(path[depth], []).append((path, n))
            if not children:
                continue
            keys = sorted(children)
            while taken[free]:
                free += 1
            place = max(free, keys[0] + 1)
            while True:
                place = taken.find(0, place)
                if all(not taken[place - keys[0] + k] for k in keys[1:]):
                    break
                place += 1
            base[state] = place - keys[0]
            for k in keys:
                child = place - keys[0] + k
                check[child], taken[child] = state, 1
                below.append((child, children[k]))
        level, depth = below, depth + 1
    used = int(np.flatnonzero(check >= 0)[-1]) + len(codes) + 2
    return Trie(base[:used], check[:used], value[:used], codes, depth - 1)


class Vocabulary(NamedTuple):
    """What tasks need: the trie, a score and the decoded bytes per id, ids of the 256 bytes, and the unknown's score."""

    trie: Trie
    scores: np.ndarray
    spoken: list[bytes]
    byte_ids: np.ndarray
    unknown: float

    @classmethod
    def of(cls, pieces: Sequence[Piece]) -> Vocabulary:
        words = {p.text: i for i, p in enumerate(pieces) if p.kind in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in words):
            raise ValueError("a piece reaches across a word's start or a line's end")
        byte_ids = np.full(256, -1, np.int32)
        spoken = [b"" if p.kind in (CONTROL, UNUSED) else p.text.replace(MARK, " ").encode() for p in pieces]
        for i, p in enumerate(pieces):
            if p.kind == BYTE:
                byte_ids[int(p.text[1:-1], 16)] = i
                spoken[i] = bytes([int(p.text[1:-1], 16)])
        if (byte_ids < 0).any():
            raise ValueError("byte fallback needs a piece for each byte")
        worst = min(pieces[i].score for i in words.values())
        return cls(build_trie(words), np.array([p.score for p in pieces]), spoken, byte_ids, worst - UNKNOWN_PENALTY)

    def segment(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each part one after another, and their numbers; parts of like length together."""
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        at = 0
        while at < len(order):
            longest = max(len(parts[order[at]]) * 5 // 4 + 2, 8)
            end = at
            while end < len(order) and len(parts[order[end]]) <= longest and (end - at) * longest < 1 << 19:
                end += 1
            end = max(end, at + 1)
            chosen = order[at:end]
            for i, ids in zip(chosen, self.viterbi([parts[i] for i in chosen])):
                done[i] = ids
            at = end
        size = np.fromiter(map(len, done), np.int64, len(done))
        return (np.concatenate(done) if done else np.zeros(0, np.int32)), size

    def viterbi(self, parts: Sequence[str]) -> list[np.ndarray]:
        """The best path through each part; of equal paths the one whose last piece starts first."""
        trie, n = self.trie, len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        width = int(sizes.max()) if n else 0
        look = trie.codes.get
        codes = np.zeros((width + 1, n), np.int32)
        flat = np.fromiter((look(c, 0) for p in parts for c in p), np.int32, int(sizes.sum()))
        codes.T[np.arange(width + 1) < sizes[:, None]] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            single = np.zeros(len(rows), bool)
            known = best[start, rows]
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for end in range(start + 1, min(start + trie.longest, width) + 1):
                code = codes[end - 1, rows[live]]
                ahead = trie.base[state] + code
                on = (code > 0) & (trie.check[ahead] == state)
                live, state = live[on], ahead[on]
                if not len(live):
                    break
                value = trie.value[state]
                ends = value >= 0
                if end == start + 1:
                    single[live[ends]] = True
                to, ids = live[ends], value[ends]
                total = known[to] + self.scores[ids]
                better = total > best[end, rows[to]]
                to, ids, total = rows[to[better]], ids[better], total[better]
                best[end, to], back[end, to], piece[end, to] = total, start, ids
            lone = np.flatnonzero(~single)
            total = known[lone] + self.unknown
            better = total > best[start + 1, rows[lone]]
            to = rows[lone[better]]
            best[start + 1, to], back[start + 1, to], piece[start + 1, to] = total[better], start, -1
        # Walk back along all paths at once.
        at, rows = sizes.copy(), np.flatnonzero(sizes > 0)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            ids, before = piece[at[rows], rows], back[at[rows], rows]
            steps.append((rows, ids, before.astype(np.int64)))
            at[rows] = before
            rows = rows[before > 0]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        if steps:
            who = np.concatenate([s[0] for s in steps[::-1]])
            ids = np.concatenate([s[1] for s in steps[::-1]])
            place = np.concatenate([s[2] for s in steps[::-1]])
            by = np.argsort(who, kind="stable")
            who, ids, place = who[by], ids[by], place[by]
            cuts = np.flatnonzero(np.diff(who)) + 1
            for row, run, places in zip(who[np.concatenate([[0], cuts])], np.split(ids, cuts), np.split(place, cuts)):
                if (run < 0).any():
                    part = parts[row]
                    run = np.concatenate([
                        self.byte_ids[list(part[p].encode())] if i < 0 else np.array([i], np.int32) for i, p in zip(run, places)
                    ])
                out[row] = run
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; byte runs that are no UTF-8 become replacement characters."""
        said = b"".join(map(self.spoken.__getitem__, ids))
        return (said[1:] if said[:1] == b" " else said).decode("utf-8", "replace")


PART = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Encoder:
    """Ids of whole texts; parts are segmented once per worker. ``first`` holds parts as they are, ``later`` parts after one marker."""

    def __init__(self, vocabulary: Vocabulary):
        self.first = Remembered(vocabulary.segment, limit=REMEMBERED)
        self.later = Remembered(lambda parts: vocabulary.segment([MARK + p for p in parts]), LATER, REMEMBERED)

    def __call__(self, batch: Sequence[str]) -> list[np.ndarray]:
        self.first.forget()
        self.later.forget()
        plain, marked, numbers, counts = self.first.__getitem__, self.later.__getitem__, [], []
        for text in batch:
            at = len(numbers)
            if not text:
                pass
            elif MARK in text or "  " in text or text[0] == " " or " \n" in text or "\n " in text or text[-1] == " ":
                numbers += map(plain, PART.findall(MARK + text.replace(" ", MARK)))
            else:
                line_end = plain("\n")
                for i, line in enumerate(text.split("\n")):
                    head, *rest = line.split(" ")
                    if i:
                        numbers.append(line_end)
                        if head:
                            numbers.append(plain(head))
                    else:
                        numbers.append(marked(head))
                    numbers += map(marked, rest)
            counts.append(len(numbers) - at)
        return runs(self.first, self.later, numbers, counts)


def load(path: str, zipf: bool = True) -> Vocabulary:
    pieces = read_model(path)
    return Vocabulary.of(zipf_scores(pieces) if zipf else pieces)


def in_tasks(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary as a broadcast value (its size is the model's, whatever the data) and the worker's encoder."""
    sent = spark.sparkContext.broadcast(vocabulary)
    name = f"pieces_{zlib.crc32(vocabulary.scores.tobytes())}"
    return sent, lambda: in_worker(name, lambda: Encoder(sent.value))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, n_bytes (byte pieces), decoded_sha256, lossless) of every row."""
    sent, encoder = in_tasks(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, encode_batch = sent.value, encoder()
        fallback = np.zeros(len(words.scores), bool)
        fallback[words.byte_ids] = True
        for batch in slices(batches):
            raw = texts(batch, "_text")
            ids = encode_batch(raw)
            back = [words.decode(i.tolist()) for i in ids]
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), lists, pa.array(size.astype(np.int64)), pa.array([int(fallback[i].sum()) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(raw, back)]),
            ], names=[id_col, "ids", "n_tokens", "n_bytes", "decoded_sha256", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, blank(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, n_bytes long, decoded_sha256 string, lossless boolean"
    )


def add_ids(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """The rows with two more columns: the ids of their text, and the text decoded from them. Columns of these names are replaced."""
    docs = docs.drop(ids_col, decoded_col)
    names = docs.columns
    sent, encoder = in_tasks(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, encode_batch = sent.value, encoder()
        for batch in slices(batches):
            ids = encode_batch([t or "" for t in batch.column(names.index(text_col)).cast(pa.string()).to_pylist()])
            lists = pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))
            back = pa.array([words.decode(i.tolist()) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], names=[*names, ids_col, decoded_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{ids_col}` array<int>, `{decoded_col}` string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    import public_tokenizers

    return encode(read_table(spark, sf_dir, "documents"), load(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
