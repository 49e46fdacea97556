"""Token counts by byte-pair merging under a given vocabulary file, as columns.

A vocabulary is a text file with one token a line, its bytes in base64 and its rank. It is read through Spark, so any path that Spark reads will do, and
sent to the workers once; its size is that of the file, whatever the corpus. A text is cut into pieces by the pattern of the vocabulary, and in
each piece the neighbouring parts of the lowest joint rank are merged, again and again. Every distinct piece is merged once per worker and
remembered (within a bound in bytes), so a corpus costs a look-up per piece and no shuffle; a join with a table of distinct pieces would
shuffle every piece of every text and meet a few very frequent ones.

Null texts have no tokens. Any bytes are tokens themselves, so every text has a count.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession, functions as F

#: Fixed value: the pattern that the byte-level vocabularies at hand were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces that a worker remembers, about.
REMEMBER = 64 << 20


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens of a piece."""
    if piece in ranks:
        return [ranks[piece]]
    parts, none = [piece[i : i + 1] for i in range(len(piece))], len(ranks) + 1
    joint = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while joint and (rank := min(joint)) < none:
        at = joint.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        # Only the ranks beside the merged pair change.
        del joint[at]
        if at < len(joint):
            joint[at] = ranks.get(parts[at] + parts[at + 1], none)
        if at:
            joint[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
    return [ranks[p] for p in parts]


class Known(dict):
    """What was made of each piece. At half of the bound the pieces become the older ones; those that are asked for again go on, and the rest is
    forgotten the next time, so frequent pieces are made once however many others come by."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: str):
        if self.held > REMEMBER // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        self.held += 100 + 10 * len(piece)
        return found


class Pieces:
    """Tokens of texts, in a worker; what is known of a piece is kept within the bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.known = Known(lambda piece: merged(piece.encode(), ranks))
        self.counts = Known(lambda piece: len(merged(piece.encode(), ranks)))
        self.spelled = {rank: token for token, rank in ranks.items()}

    def __call__(self, piece: str) -> list[int]:
        return self.known[piece]

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.pattern.findall(text))) if text else 0

    def tokens(self, text: str) -> list[int]:
        return [t for p in self.pattern.findall(text) for t in self(p)]


_own: dict[str, Pieces] = {}


def in_worker(name: str, ranks: Broadcast, pattern: str) -> Pieces:
    """One for each worker process, which later tasks find again."""
    if name not in _own:
        _own[name] = Pieces(ranks.value, pattern)
    return _own[name]


def shortened(tokens: list[int], keep: int, strategy: str) -> tuple[list[int], list[int]]:
    """Tokens before and after the cut."""
    if strategy == "end":
        return tokens[:keep], []
    if strategy == "start":
        return [], tokens[-keep:]
    return tokens[: keep // 2], tokens[-(keep - keep // 2) :]


class BytePairs:
    """A token estimator: called with a text column it counts tokens, :meth:`each` counts those of an array's texts, :meth:`cut` truncates."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERN):
        lines = [r.value.split() for r in spark.read.text(path).where("value != ''").collect()]
        ranks = spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in lines})
        name = uuid.uuid4().hex
        self._pieces = lambda: in_worker(name, ranks, pattern)
        self._count = F.pandas_udf(self._of(lambda own, text: own.count(text)), "int")
        self._each = F.pandas_udf(self._of(lambda own, texts: None if texts is None else [own.count(t) for t in texts]), "array<int>")

    def _of(self, one: Callable) -> Callable:
        pieces = self._pieces

        def run(batches):
            own = pieces()
            for values in batches:
                yield pd.Series([one(own, v) for v in values], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return run

    def __call__(self, text: Column | str) -> Column:
        return self._count(text)

    def each(self, texts: Column | str) -> Column:
        return self._each(texts)

    def cut(self, text: Column | str, max_tokens: int, strategy: str = "end", ellipsis: str = "...") -> Column:
        """The text within ``max_tokens`` tokens, the mark's own tokens included; bytes of a character that the cut splits are replaced."""
        if strategy not in ("end", "start", "middle"):
            raise ValueError(f"unknown truncation strategy: {strategy}")

        def one(own: Pieces, value: str | None) -> str:
            if not value or own.count(value) <= max_tokens:
                return value or ""
            keep = max_tokens - own.count(ellipsis)
            if keep <= 0:
                return ellipsis
            head, tail = (b"".join(own.spelled[t] for t in part).decode(errors="replace") for part in shortened(own.tokens(value), keep, strategy))
            return head + ellipsis + tail

        return F.pandas_udf(self._of(one), "string")(text)
