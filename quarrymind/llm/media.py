"""Payloads as motion-JPEG AVI files: write, parse, decode, and cut into timed clips.

A payload is stored losslessly in the unit of its format, the quantised DCT coefficient. One block of 64 bytes
is one 8 x 8 block whose coefficients all have magnitude category 8; that category has 256 values and its
eight appended bits are the byte itself. With one Huffman code of one bit and a restart marker after every block
(which resets the DC prediction) a block takes 576 bits, and a frame is a valid baseline grey-scale JPEG whose
coefficients any decoder reads back exactly.

Frames are read as baseline JPEG by their own tables, whoever wrote them: Huffman codes, runs, DC prediction, restarts, sampling factors,
dequantisation and inverse DCT. All restart intervals of a batch of frames are decoded side by side. A payload is
what the coefficients hold; a movie of other coefficients has pixels and shots, but reading a payload from it raises an error.

Files are RIFF: ``hdrl`` (main and stream headers), an ``INFO`` comment with the payload's length, ``movi`` with one intra frame per ``00dc``
chunk, and an ``idx1`` index through which frames are found again.

Shots: consecutive frames are compared by the histogram difference of their pixels; a cut is a difference above the mean plus
``spread`` deviations of the differences of the current shot so far, and above ``floor``. Clips are timed by the frame rate.

Everything is a map over rows. Null and empty texts give a payload of one zero block. Each row is its own file, so equal texts
give equal files; a file is limited by RIFF's 32-bit sizes, and a longer payload raises an error rather than being cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrymind.llm.common import blank, read_table, slices, utf8

BLOCK = 64
BLOCK_BYTES = 72
FRAME_BLOCKS = 16
BLOCKS_ACROSS = 4
RATE = 25
BINS = 32

# JPEG markers.
SOI, EOI, DQT, SOF0, DHT, DRI, SOS = b"\xff\xd8", b"\xff\xd9", 0xDB, 0xC0, 0xC4, 0xDD, 0xDA
ONE_CODE = bytes([1] + [0] * 15)
OTHER_FRAMES = set(range(0xC1, 0xD0)) - {0xC4, 0xC8, 0xCC}

#: Entropy-coded bytes that are decoded side by side, about.
GROUP_BYTES = 1 << 20


class Clip(NamedTuple):
    first_frame: int
    last_frame: int
    start_ms: int
    end_ms: int


def padded(data: bytes) -> bytes:
    """The data with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head(blocks: int) -> bytes:
    across = min(blocks, BLOCKS_ACROSS)
    width, height = 8 * across, 8 * -(-blocks // across)
    return (
        SOI + segment(DQT, bytes([0]) + bytes([1]) * 64)
        + segment(SOF0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + segment(DHT, bytes([0x00]) + ONE_CODE + bytes([8])) + segment(DHT, bytes([0x10]) + ONE_CODE + bytes([0x08]))
        + segment(DRI, struct.pack(">H", 1)) + segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def coded(blocks: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of (n, 64) samples, 72 for each block: a zero bit and eight appended bits per coefficient."""
    bits = np.zeros((len(blocks), BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks[:, :, None], axis=2)
    return np.packbits(bits.reshape(len(blocks), BLOCK * 9), axis=1)


def frame(blocks: np.ndarray) -> bytes:
    """One JPEG image of (n, 64) samples."""
    rows = np.empty((len(blocks), BLOCK_BYTES + 2), np.uint8)
    rows[:, :BLOCK_BYTES] = coded(blocks)
    rows[:, BLOCK_BYTES] = 0xFF
    rows[:, BLOCK_BYTES + 1] = 0xD0 + np.arange(len(blocks)) % 8
    flat = rows.reshape(-1)[:-2]
    stuffing = flat == 0xFF
    stuffing.reshape(-1)[np.arange(BLOCK_BYTES, len(flat), BLOCK_BYTES + 2)] = False
    at = np.flatnonzero(stuffing)
    return frame_head(len(blocks)) + np.insert(flat, at + 1, 0).tobytes() + EOI


class Head(NamedTuple):
    """What a JPEG image says before and around its entropy-coded data, which has its stuffing and restart markers taken out."""

    width: int
    height: int
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    codes: list[tuple[bytes, bytes]]
    restart: int
    data: np.ndarray
    starts: np.ndarray


class Picture(NamedTuple):
    """Coefficients of each component, (blocks, 64) in zigzag order and in raster order of the blocks, and its pixels, (height, width)."""

    coefficients: list[np.ndarray]
    planes: list[np.ndarray]
    restart: int


@lru_cache(256)
def code_table(body: bytes) -> np.ndarray:
    """``length << 8 | symbol`` of the code that each 16 bits begin with, 0 if none does; ``body`` is that of a DHT table."""
    out, at, value = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            span = 1 << (16 - length)
            if at + span > 1 << 16 or value >= len(body):
                raise ValueError("not a Huffman table")
            out[at : at + span] = length << 8 | body[value]
            at, value = at + span, value + 1
    return out


def head_of(image: bytes) -> Head:
    """The tables, sizes and data of a baseline image of one scan; another JPEG process raises an error."""
    if image[:2] != SOI:
        raise ValueError("not a JPEG image")
    at, quant, codes, size, parts, restart = 2, {}, {}, None, [], 0
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("not a JPEG marker")
        mark, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        if mark == 0xFF:  # fill
            at += 1
            continue
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if mark == DQT:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * bool(wide) :]
        elif mark == DHT:
            while body:
                end = 17 + sum(body[1:17])
                codes[body[0]] = body[1:end]
                body = body[end:]
        elif mark == SOF0:
            bits, *size, n = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8:
                raise ValueError("eight bits expected")
        elif mark in OTHER_FRAMES:
            raise ValueError("another JPEG process than the baseline one")
        elif mark == DRI:
            restart = int.from_bytes(body[:2], "big")
        elif mark == SOS:
            break
    used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if size is None or not all(size) or used.keys() != {p[0] for p in parts}:
        raise ValueError("one scan of all components expected")
    try:
        tables = [(codes[used[p[0]] >> 4], codes[0x10 | used[p[0]] & 15]) for p in parts]
        quants = [quant[p[3]] for p in parts]
    except KeyError:
        raise ValueError("a table that the frame does not hold") from None
    data = np.frombuffer(image, np.uint8, offset=at)
    after = np.flatnonzero(data[:-1] == 0xFF) + 1
    ends = after[(data[after] != 0) & ((data[after] & 0xF8) != 0xD0) & (data[after] != 0xFF)]
    if len(ends):
        data, after = data[: ends[0] - 1], after[after < ends[0]]
    drop = np.zeros(len(data), bool)
    drop[after[data[after] == 0]] = True
    marks = after[(data[after] & 0xF8) == 0xD0]
    drop[marks] = True
    drop[marks - 1] = True
    starts = np.concatenate([[0], marks + 1 - np.cumsum(drop)[marks]]).astype(np.int64)
    sampling = [(1, 1)] if len(parts) == 1 else [p[1:3] for p in parts]
    return Head(size[1], size[0], sampling, quants, tables, restart, data[~drop], starts)


def coefficients_of(heads: list[Head]) -> list[np.ndarray]:
    """(blocks, 64) coefficients of each image in the order of its scan. All restart intervals go side by side, a symbol of each at a time."""
    bodies, tables, owners = {}, [], []
    lanes: list[list] = [[], [], [], []]  # first bit, end bit, blocks, place of the first block
    longest = max(sum(h * v for h, v in head.sampling) for head in heads)
    part_of, per = np.zeros((len(heads), longest), np.int64), np.zeros(len(heads), np.int64)
    codes = np.zeros((2, len(heads), max(len(head.sampling) for head in heads)), np.int64)
    base, place, sizes = 0, 0, []
    for i, head in enumerate(heads):
        order = [c for c, (h, v) in enumerate(head.sampling) for _ in range(h * v)]
        part_of[i, : len(order)], per[i] = order, len(order)
        for c, pair in enumerate(head.codes):
            for kind, body in enumerate(pair):
                if body not in bodies:
                    bodies[body] = len(tables)
                    tables.append(code_table(body))
                codes[kind, i, c] = bodies[body]
        across, down = (max(s[k] for s in head.sampling) * 8 for k in (0, 1))
        units = -(-head.width // across) * -(-head.height // down)
        step = head.restart or units
        if len(head.starts) != -(-units // step):
            raise ValueError("restart markers are missing")
        todo = np.minimum(units - np.arange(len(head.starts)) * step, step) * len(order)
        lanes[0].append((base + head.starts) * 8)
        lanes[1].append((base + np.append(head.starts[1:], len(head.data))) * 8)
        lanes[2].append(todo)
        lanes[3].append(place + np.cumsum(todo) - todo)
        owners.append(np.full(len(head.starts), i))
        base, place = base + len(head.data), place + units * len(order)
        sizes.append(units * len(order))
    pos, end, blocks, first = map(np.concatenate, lanes)
    owner, table = np.concatenate(owners), np.concatenate(tables)
    raw = np.concatenate([*(head.data for head in heads), np.zeros(8, np.uint8)]).astype(np.int64)
    words = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]
    out, guess = np.zeros((place, BLOCK), np.int32), np.zeros((len(pos), codes.shape[2]), np.int64)

    def symbol(lane: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each lane and the value of the bits appended to it."""
        at = pos[lane]
        if (at >= end[lane]).any():
            raise ValueError("the data end within a block")
        word, left = words[at >> 3], 40 - (at & 7)
        entry = table[which << 16 | word >> left - 16 & 0xFFFF]
        length, code = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("a code that is not in the frame's tables")
        size = code & 15
        value = word >> left - length - size & (1 << size) - 1
        pos[lane] = at + length + size
        return code, np.where(value < 1 << size >> 1, value - (1 << size) + 1, value)

    for turn in range(int(blocks.max())):
        lane = np.flatnonzero(blocks > turn)
        part = part_of[owner[lane], turn % per[owner[lane]]]
        code, value = symbol(lane, codes[0, owner[lane], part])
        if (code > 11).any():
            raise ValueError("not a DC code")
        guess[lane, part] += value
        row = first[lane] + turn
        out[row, 0] = guess[lane, part]
        which, k = codes[1, owner[lane], part], np.ones(len(lane), np.int64)
        while len(lane):
            code, value = symbol(lane, which)
            k += code >> 4
            stop = code == 0
            if (k[~stop] >= BLOCK).any():
                raise ValueError("a run that is longer than its block")
            out[row[~stop], k[~stop]] = value[~stop]
            k += 1
            stop |= k == BLOCK
            if stop.any():
                lane, row, which, k = (x[~stop] for x in (lane, row, which, k))
    if (pos > end).any():
        raise ValueError("the data end within a block")
    return np.split(out, np.cumsum(sizes)[:-1])


@lru_cache(1)
def basis() -> np.ndarray:
    """The inverse DCT of a zigzag vector in units of 2**-16. Whole numbers, so that sums are exact in whatever order they are added."""
    wave = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
    wave[0] /= 2**0.5
    order = sorted(((v, u) for v in range(8) for u in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([np.round(np.outer(wave[v], wave[u]) * 65536).reshape(-1) for v, u in order])


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(n, 64) pixels of (n, 64) coefficients: dequantised, transformed, shifted and cut to a byte."""
    flat = (coefficients * quant).astype(np.float64) @ basis()
    return np.clip(np.floor((flat + 32768) / 65536) + 128, 0, 255).astype(np.uint8)


def read_frames(images: list[bytes]) -> Iterator[Picture]:
    """Baseline JPEG images, some megabytes of them at a time."""
    heads = [head_of(image) for image in images]
    sizes = np.cumsum([len(head.data) for head in heads]) // GROUP_BYTES
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(heads)]):
        for head, scan in zip(heads[a:b], coefficients_of(heads[a:b])):
            yield picture(head, scan)


def picture(head: Head, scan: np.ndarray) -> Picture:
    """Blocks of a scan put in their places."""
    most = [max(s[k] for s in head.sampling) for k in (0, 1)]
    across, down = -(-head.width // (8 * most[0])), -(-head.height // (8 * most[1]))
    units, at, found, planes = scan.reshape(across * down, -1, BLOCK), 0, [], []
    for (h, v), quant in zip(head.sampling, head.quant):
        part = units[:, at : at + h * v].reshape(down, across, v, h, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
        at += h * v
        plane = pixels(part, quant).reshape(down * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        found.append(part)
        planes.append(plane[: -(-head.height * v // most[1]), : -(-head.width * h // most[0])])
    return Picture(found, planes, head.restart)


def samples(image: Picture) -> np.ndarray:
    """(n, 64) bytes that the coefficients of this format's writer hold, which restarts after each block; others raise an error."""
    found = image.coefficients[0]
    if len(image.coefficients) != 1 or image.restart != 1 or ((np.abs(found) >> 7) != 1).any():
        raise ValueError("coefficients that hold no payload")
    return np.where(found > 0, found, found + 255).astype(np.uint8)


def read_frame(image: bytes) -> np.ndarray:
    """(n, 64) samples of an image."""
    return samples(next(read_frames([image])))


def chunk(name: bytes, body: bytes) -> bytes:
    if len(body) >= 1 << 32:
        raise ValueError("longer than a RIFF chunk can be")
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI file of a payload whose length is a positive multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    per = min(FRAME_BLOCKS, len(blocks))
    per += -per % min(per, BLOCKS_ACROSS)  # whole rows, so that a frame holds all blocks of its size
    fill = -len(blocks) % per
    if fill:
        blocks = np.concatenate([blocks, np.zeros((fill, BLOCK), np.uint8)])
    images = [frame(blocks[i : i + per]) for i in range(0, len(blocks), per)]
    across = min(per, BLOCKS_ACROSS)
    width, height, longest = 8 * across, 8 * -(-per // across), max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // RATE, longest * RATE, 0, 0x10, len(images), 0, 1, longest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, RATE, 0, len(images), longest, 10_000, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"%d" % len(payload)))
    movi, index, at = [], [], 4
    for image in images:
        part = chunk(b"00dc", image)
        movi.append(part)
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(image)))
        at += len(part)
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


class Movie(NamedTuple):
    """What a file's RIFF structure tells: frame places from the index, frame time, payload length."""

    frames: list[tuple[int, int]]
    frame_us: int
    payload_bytes: int


def parse_avi(data: bytes) -> Movie:
    """Walk the RIFF chunks and read the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, frame_us, length = 0, b"", 0, 0
    todo = [(12, 8 + int.from_bytes(data[4:8], "little"))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                frame_us = int.from_bytes(data[at + 8 : at + 12], "little")
            elif name == b"ICMT":
                length = int(data[at + 8 : at + 8 + size])
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    frames = [(movi + at + 8, size) for name, _, at, size in struct.iter_unpack("<4s3I", index) if name == b"00dc"]
    return Movie(frames, frame_us, length)


def read_avi(data: bytes) -> tuple[Movie, np.ndarray]:
    """The file's structure and the samples of its frames, (frames, blocks, 64)."""
    movie = parse_avi(data)
    return movie, np.stack([samples(p) for p in read_frames([data[at : at + size] for at, size in movie.frames])])


def payload_of(movie: Movie, frames: np.ndarray) -> bytes:
    return frames.tobytes()[: movie.payload_bytes]


def clips(frames: np.ndarray, frame_us: int, spread: float = 3.0, floor: float = 0.25) -> list[Clip]:
    """Shots of a movie, given its frames' bytes, as timed clips."""
    n = len(frames)
    bins = (frames.reshape(n, -1) >> 3).astype(np.int64) + np.arange(n)[:, None] * BINS
    counts = np.bincount(bins.reshape(-1), minlength=n * BINS).reshape(n, BINS) / (frames.size // n)
    change = (np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2).round(9).tolist()
    starts, seen, total, squares = [0], 0, 0.0, 0.0
    for i, d in enumerate(change, 1):
        mean = total / seen if seen else 0.0
        deviation = max(squares / seen - mean * mean, 0.0) ** 0.5 if seen else 0.0
        if d > floor and d > mean + spread * deviation:
            starts.append(i)
            seen, total, squares = 0, 0.0, 0.0
        else:
            seen, total, squares = seen + 1, total + d, squares + d * d
    ends = [*starts[1:], n]
    return [Clip(a, b - 1, a * frame_us // 1000, b * frame_us // 1000) for a, b in zip(starts, ends)]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) with one AVI file per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            raw = utf8(batch, "_text")
            files = pa.array([write_avi(padded(t)) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, raw), pa.int64()), files], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, blank(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


CLIP_TYPE = "array<struct<first_frame:int,last_frame:int,start_ms:long,end_ms:long>>"


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Parse and decode the stored files: payload digests, file digest and clips; ``media`` itself is left out."""
    clip = pa.list_(pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows: list[list] = [[], [], [], [], [], []]
            files = batch.column("media").to_pylist()
            movies = [parse_avi(data) for data in files]
            read = read_frames([data[at : at + size] for data, movie in zip(files, movies) for at, size in movie.frames])
            for data, movie in zip(files, movies):
                parts = [(samples(p), p.planes[0]) for p in islice(read, len(movie.frames))]
                payload = payload_of(movie, np.stack([p[0] for p in parts]))
                found = [c._asdict() for c in clips(np.stack([p[1] for p in parts]), movie.frame_us)]
                for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), found)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip)
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *map(pa.array, rows, kinds)], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        f" media_sha256 string, clips {CLIP_TYPE}",
    )


def clip_rows(described: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per clip of each movie."""
    return described.selectExpr(f"`{id_col}`", "media_sha256", "posexplode(clips) as (clip, span)").selectExpr(f"`{id_col}`", "media_sha256", "clip", "span.*")


def op7_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through an AVI file and back; ``feature`` lists its clips as first-last frame and times."""
    rows = describe(to_media(read_table(spark, sf_dir, "documents")))
    return rows.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat_ws(';', transform(clips, c -> concat(c.first_frame, '-', c.last_frame, '@', c.start_ms, '-', c.end_ms))) as feature",
    )


QUERIES = {"op7_motion_jpeg": op7_motion_jpeg}
ORACLES: dict[str, str] = {}
