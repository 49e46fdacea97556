"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is ``w . x`` over surface features ``x`` of its text. Preference pairs (a document marked good
against one marked bad) are drawn from labelled rows and ``w`` minimises the logistic loss on feature differences
``x_good - x_bad``. A quantile of the labelled worths, at the share of bad rows, is the cut; worth is mapped to (0, 1) so
that the cut gets ``threshold``.

Fitting uses at most ``max_rows`` labelled rows (those with the smallest hash of their id; a documented bound) and
``pairs_per_row`` pairs for each; scoring reads every row and whole texts, without a shuffle.

Null texts count as empty; empty and blank texts have features of zero and get a score like any other. Repeated ids and
rows are scored one by one. Labels that are null are not used; if no row of one class is left, every score is 0.5.
Columns beyond the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymind.llm.common import blank, crc_bucket, read_table, slices, utf8

FEATURES = (
    "log_words", "distinct", "repeats", "bars", "symbols", "upper", "digits", "word_bytes", "long_words", "line_repeats",
    "stops", "short_words", "shouted", "marked",
)
SYMBOLS = b"%#$&*!@^~=<>{}[]\\_+|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
STOPS = b".?,;:"


def features(text: bytes) -> list[float]:
    """Surface features of one UTF-8 text; shares lie between 0 and 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    distinct = len(set(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    long = b"".join(words)

    def share(marks: bytes) -> float:
        return (size - len(long.translate(None, marks))) / size

    doubled = sum(map(bytes.__eq__, words[1:], words[:-1]))
    loud = sum(1 for w in words if len(w) > 1 and w.isupper())
    tail = sum(1 for w in words if w[-1] in SYMBOLS)
    return [
        math.log1p(n) / 10, distinct / n**0.9, doubled / n, min(1.0, text.count(b"|") / n), min(1.0, 4 * share(SYMBOLS)),
        share(UPPER), share(DIGITS), min(1.0, size / n / 20), sum(1 for w in words if len(w) > 25) / n,
        1 - len(set(lines)) / len(lines), min(1.0, 4 * share(STOPS)), sum(1 for w in words if len(w) <= 3) / n, loud / n, tail / n,
    ]


@dataclass(frozen=True)
class Ranker:
    """Fitted weights, with the place and slope of the map from worth to score."""

    weights: tuple[float, ...]
    cut: float
    slope: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not any(self.weights):
            return np.full(len(x), 0.5)
        z = self.slope * (x @ np.array(self.weights) - self.cut) + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float, pairs_per_row: int = 8, ridge: float = 1e-3, steps: int = 30, seed: int = 7) -> Ranker:
    """Weights by Newton steps on the logistic loss of feature differences; the cut by a quantile of all worths."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranker((0.0,) * x.shape[1], 0.0, 1.0, threshold)
    draw = np.random.default_rng(seed)
    n = pairs_per_row * len(x)
    d = good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ p / n - ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    worth = x @ w
    ranked, share = np.sort(worth), float(np.mean(y == 0))
    # The quantile at the share of bad rows: half way between the two rows that it parts.
    at = min(max(round(share * len(ranked)), 1), len(ranked) - 1)
    cut = float((ranked[at - 1] + ranked[at]) / 2)
    spread = float(np.median(np.abs(worth - cut))) or 1.0
    return Ranker(tuple(map(float, w)), cut, 3.0 / spread, threshold)


def fit(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> Ranker:
    """Fit on the labelled rows of ``docs``. At most ``max_rows`` (id, label) rows are taken, so both they and their
    features have a fixed size; the texts are featurised where they lie."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).dropDuplicates(["_id"])
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), blank(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in utf8(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_label").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["i", "y", "x"])

    got = sorted(rows.mapInArrow(featurised, "i string, y int, x array<double>").collect())
    x = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES))
    return fit_pairs(x, np.array([r.y for r in got], int), threshold)


def scores(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in utf8(batch, "_text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ranker.score(x), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, blank(text_col).alias("_text")).mapInArrow(scored, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows that reach the threshold, with all their columns and no shuffle."""
    names = docs.columns

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(names.index(text_col)).cast(pa.string()).fill_null("").cast(pa.binary()).to_pylist()
            x = np.array([features(t) for t in raw], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(ranker.score(x) >= ranker.threshold))

    return docs.mapInArrow(good, docs.schema)


HELD_OUT = 2
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col) == HELD_OUT


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learnt only from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    ranker = fit(docs, read_table(spark, sf_dir, "labels").where(~held_out()), THRESHOLD)
    return scores(docs, ranker).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op9_quality_ranking": op9_quality_ranking}
ORACLES: dict[str, str] = {}
