"""Token ids in directly addressable codes, written as files and read back.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids
that have one, and so on; a bitmap per level tells which ids go on, and a directory of ranks (one per 512 bits) finds
an id's place in the next level. Any single id is read with one look-up per level, without decoding its neighbours.

Files: a Parquet table of segments in the shared folder, in ascending id order (nulls first; equal ids by the hash of their text). A segment
holds whole documents up to ``SEGMENT`` ids (a longer document alone) and its place within its partition, so
places in the whole corpus need one sum per partition.

Null and empty texts are one end id. Repeated rows are written one by one. Further columns are left out.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrymind.llm.common import LATER, Remembered, blank, cut_lineage, in_worker, read_table, runs, slices, texts

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT = 1 << 16
END_ID = 0


# ---- the codes ----

def pack(ids: np.ndarray) -> bytes:
    """Codes of unsigned ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        go_on = rest >> CHUNK_BITS > 0
        bitmap = np.packbits(go_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.cumsum(ones, dtype=np.uint32) - ones
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[go_on] >> CHUNK_BITS
        if not len(rest):
            break
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Codes:
    """Packed ids: any one of them, or a run of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, self.levels = 5, []
        for _ in range(data[4]):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + len(bitmap) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``, by one rank per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = bitmap[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def run(self, start: int, end: int) -> np.ndarray:
        """Ids at places ``start`` to ``end``, without touching others but their bitmap block."""
        out = np.zeros(max(end - start, 0), np.uint32)
        into = np.arange(len(out))
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            if end <= start:
                break
            out[into] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            block = start // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : -(-end // 8)], bitorder="little")
            lead = start - block * RANK_BITS
            go_on = bits[lead : lead + end - start].astype(bool)
            start = int(ranks[block]) + int(bits[:lead].sum())
            into = into[go_on]
            end = start + len(into)
        return out


# ---- encoding ----

# A space after a character that is no white space begins a new token under the tokenizer's pattern, whatever surrounds it.
AFTER_TEXT = re.compile(r"(?<=\S) ")
SPACES = re.compile(r"\s\s")
LINE_END = "\n"


class Encoder:
    """Byte-level BPE ids of whole texts, by the tokenizers library; pieces between spaces are encoded once per worker.

    Special tokens' strings in a text are their ids, as the library has it; what stands between them is encoded as a text of its own.
    New pieces go to the library in lines: a line end is a token of its own beside a piece without white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special tokens that take in what surrounds them")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else "(?!)")
        (self.line_end,) = self.ids([LINE_END])[0]
        self.first, self.later = Remembered(self.encode), Remembered(lambda pieces: self.encode(pieces, " "), LATER)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, pieces: list[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        # These go to the library one by one: a line end beside them is no token of its own.
        alone = re.compile(rf"^$|\s|{self.special.pattern}")
        spaced = [n for n, p in enumerate(pieces) if alone.search(p)] if "" in pieces or alone.search("".join(pieces) or "x") else []
        if spaced:
            taken = set(spaced)
            own = self.ids([lead + pieces[n] for n in spaced])
            plain, sizes = self.encode([p for n, p in enumerate(pieces) if n not in taken], lead)
            runs = np.split(plain, np.cumsum(sizes))[:-1]
            for n, run in zip(spaced, own):
                runs.insert(n, np.array(run, np.int32))
            return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
        between = LINE_END + lead
        lines = [lead + between.join(pieces[i : i + 64]) + LINE_END for i in range(0, len(pieces), 64)]
        stream = np.fromiter(chain.from_iterable(self.ids(lines)), np.int32)
        ends = stream == self.line_end
        return stream[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def __call__(self, batch: Sequence[str]) -> list[np.ndarray]:
        self.first.forget()
        self.later.forget()
        first, later, numbers, counts = self.first.__getitem__, self.later.__getitem__, [], []
        for text in batch:
            at = len(numbers)
            # Every other part is a special token.
            for k, part in enumerate(self.special.split(text)):
                if k % 2:
                    numbers.append(first(part))
                elif SPACES.search(part):
                    head, *rest = AFTER_TEXT.split(part)
                    numbers.append(first(head))
                    numbers += map(later, rest)
                else:
                    # White space stands alone everywhere, so a line end is a token of its own, too.
                    for i, line in enumerate(part.split(LINE_END)):
                        head, *rest = line.split(" ")
                        if i:
                            numbers.append(first(LINE_END))
                        numbers.append(first(head))
                        numbers += map(later, rest)
            counts.append(len(numbers) - at)
        return runs(self.first, self.later, numbers, counts)


def byte_bpe(path: str) -> Callable[[], Encoder]:
    return lambda: in_worker(f"encoder_{zlib.crc32(path.encode())}", lambda: Encoder(path))


SEGMENT_TYPE = "part int, first long, n_ids long, ids array<{id}>, sizes array<long>, codes binary"


def write(docs: DataFrame, encoder: Callable[[], Callable[[Sequence[str]], list[np.ndarray]]], id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Encode, order and write the documents; the written table of segments."""
    rows = docs.select(F.col(id_col).alias("_id"), blank(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kind = docs.schema[id_col].dataType.simpleString()
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first, held, size, part = encoder(), 0, [], 0, None

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([i for _, i in held])
            columns = [[part], [first], [len(ids)], pa.concat_arrays([i for i, _ in held]), [len(i) for _, i in held], [pack(ids)]]
            columns[3] = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), columns[3])
            kinds = [pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary()]
            columns[4] = [columns[4]]
            return pa.RecordBatch.from_arrays(
                [c if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "first", "n_ids", "ids", "sizes", "codes"]
            )

        for batch in slices(batches):
            part = batch.column("_part")[0].as_py() if part is None else part
            for i, ids in enumerate(encode(texts(batch, "_text"))):
                ids = np.concatenate([ids, np.array(end, np.int32)])
                if held and size + len(ids) > SEGMENT:
                    yield segment()
                    first, held, size = first + size, [], 0
                held.append((batch.column("_id").slice(i, 1), ids))
                size += len(ids)
        if held:
            yield segment()

    return cut_lineage(rows.mapInArrow(run, SEGMENT_TYPE.format(id=kind)), "codes")


def read(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the written segments."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # One row per written partition: their number is a setting, not a size of the data.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    kind = segments.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for row in range(batch.num_rows):
                codes = Codes(batch.column("codes")[row].as_py())
                start, at = batch.column("offset")[row].as_py() + batch.column("first")[row].as_py(), 0
                starts, checks = [], []
                sizes = batch.column("sizes")[row].as_py()
                stored = memoryview(codes.run(0, len(codes)).astype("<u4").tobytes())
                for n in sizes:
                    starts.append(start + at)
                    checks.append(zlib.crc32(stored[4 * at : 4 * (at + n)]))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, *(pa.array(c, pa.int64()) for c in (starts, sizes, checks))],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    rows = segments.join(F.broadcast(offsets), "part").select("first", "offset", "ids", "sizes", "codes")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in ascending id order, and read back."""
    import public_tokenizers

    return read(write(read_table(spark, sf_dir, "documents"), byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))))


QUERIES = {"op6_addressable_codes": op6_addressable_codes}
ORACLES: dict[str, str] = {}
