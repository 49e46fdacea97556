"""Baseline JPEG frames of another writer, against a plain encoder and a plain inverse transform."""

import math
import struct

import numpy as np
import pytest

from quarrymind.llm import media

ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
DC, AC = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]


def code(symbols, symbol):
    n = 4 if symbols is DC else 8
    return format(symbols.index(symbol), f"0{n}b")


def magnitude(value):
    size = abs(int(value)).bit_length()
    return size, format(int(value) if value > 0 else int(value) + (1 << size) - 1, f"0{size}b") if size else ""


def block_bits(block, before):
    size, extra = magnitude(block[0] - before)
    bits, run = code(DC, size) + extra, 0
    for value in block[1:]:
        if not value:
            run += 1
            continue
        while run > 15:
            bits, run = bits + code(AC, 0xF0), run - 16
        size, extra = magnitude(value)
        bits, run = bits + code(AC, run << 4 | size) + extra, 0
    return bits + (code(AC, 0x00) if run else "")


def encoded(parts, quants, sampling, width, height, restart):
    """``parts`` (rows, columns, 64) in zigzag order."""
    across, down = (-(-n // (8 * max(s[k] for s in sampling))) for k, n in ((0, width), (1, height)))
    out, bits, before = b"", "", [0] * len(parts)

    def flushed():
        whole = bits + "1" * (-len(bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\0")

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            out, bits, before = out + flushed() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]), "", [0] * len(parts)
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    block = parts[c][unit // across * v + y, unit % across * h + x]
                    bits, before[c] = bits + block_bits(block, before[c]), block[0]
    n = len(parts)
    head = b"\xff\xd8" + media.segment(0xE0, b"JFIF\0") + b"".join(media.segment(0xDB, bytes([i, *q])) for i, q in enumerate(quants))
    head += media.segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, i]) for i, (h, v) in enumerate(sampling)))
    head += media.segment(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12 + DC) + bytes([0x10] + [0] * 7 + [len(AC)] + [0] * 8 + AC))
    head += media.segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + media.segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + out + flushed() + b"\xff\xd9"


def plain_pixels(block, quant):
    natural = np.zeros(64)
    natural[ZIGZAG] = block * np.array(quant)
    c = [0.5**0.5] + [1] * 7
    return [
        [128 + sum(c[u] * c[v] * natural[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4
         for x in range(8)] for y in range(8)
    ]


@pytest.mark.parametrize("sampling, restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_frames_of_another_writer(sampling, restart):
    draw = np.random.default_rng(len(sampling) + restart)
    width, height = 37, 29
    across, down = (-(-n // (8 * max(s[k] for s in sampling))) for k, n in ((0, width), (1, height)))
    quants = [draw.integers(1, 9, 64).tolist() for _ in sampling]
    parts = [(draw.integers(-60, 61, (down * v, across * h, 64)) * (draw.random((down * v, across * h, 64)) < 0.12)).astype(int) for h, v in sampling]
    parts[0][0, 0] = [0] * 63 + [1023]
    (got,) = media.read_frames([encoded(parts, quants, sampling, width, height, restart)])
    for part, quant, found, plane, (h, v) in zip(parts, quants, got.coefficients, got.planes, sampling):
        assert (found == part.reshape(-1, 64)).all()
        assert plane.shape == (-(-height * v // max(s[1] for s in sampling)), -(-width * h // max(s[0] for s in sampling)))
        y, x = min(1, len(part) - 1), 1
        want = np.clip(np.array(plain_pixels(part[y, x], quant)), 0, 255)
        shown = plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8]
        assert np.abs(shown - want[: shown.shape[0], : shown.shape[1]]).max() < 0.51
    with pytest.raises(ValueError):
        media.samples(got)


def test_cut_data_are_refused():
    image = media.frame(np.arange(128, dtype=np.uint8).reshape(2, 64))
    with pytest.raises(ValueError):
        media.read_frame(image[:-40] + b"\xff\xd9")
    with pytest.raises(ValueError):
        media.read_frame(image.replace(b"\xff\xc0", b"\xff\xc2"))


def test_frames_hold_all_blocks_of_their_size():
    for n in range(1, 40):
        payload = bytes(range(256)) * (n // 4) + b"x" * (n % 4 * 64)
        data = media.write_avi(payload)
        movie, frames = media.read_avi(data)
        assert media.payload_of(movie, frames) == payload
        for at, size in movie.frames:
            head = media.head_of(data[at : at + size])
            assert head.width * head.height == 64 * len(head.starts)
