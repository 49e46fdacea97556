"""What the operators of this folder share: reading tables, small Arrow batches, written intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymind.session import cut_lineage

__all__ = ["LATER", "Remembered", "blank", "crc_bucket", "cut_lineage", "in_worker", "read_table", "runs", "slices", "texts", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(column: str) -> Column:
    """The text, or the empty one where there is none."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_bucket(column: str, buckets: int = 4) -> Column:
    """Stable bucket of an id: crc32 of its decimal text (of the empty text if null)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).to_pylist()


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, without decoding it first."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def in_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as its Python worker; later tasks of the worker find it again."""
    home = sys.modules.setdefault("_quarrymind_worker", types.ModuleType("_quarrymind_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


class Remembered(dict):
    """Numbers of the strings seen, and a run of token ids for each: ``encode`` is called once per string.

    Looking a string up gives its number, from ``base`` on; ``settle`` encodes what is new, and then :func:`runs` joins the ids. At
    ``limit`` strings all is forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], base: int = 0, limit: int = 1_000_000):
        super().__init__()
        self.encode, self.base, self.limit, self.new = encode, base, limit, []
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __missing__(self, key: str) -> int:
        self[key] = number = self.base + len(self)
        self.new.append(key)
        return number

    def settle(self) -> None:
        if self.new:
            flat, size = self.encode(self.new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.new = []

    def forget(self) -> None:
        """Call between batches."""
        if len(self) >= self.limit:
            self.clear()
            self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)


LATER = 1 << 40


def runs(first: Remembered, later: Remembered, numbers: list[int], counts: list[int]) -> list[np.ndarray]:
    """Token ids of each text, given the numbers of all texts' strings in order and how many each text has. Numbers from
    ``LATER`` on belong to the store ``later``, which has that base."""
    first.settle()
    later.settle()
    which = np.fromiter(numbers, np.int64, len(numbers))
    size, start, ids = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.concatenate([first.flat, later.flat])
    second = which >= LATER
    for store, mine, shift in ((first, ~second, 0), (later, second, len(first.flat))):
        own = which[mine] - store.base
        size[mine], start[mine] = store.size[own], store.start[own] + shift
    ends = np.cumsum(size)
    flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
    cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
