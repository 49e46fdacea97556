"""Byte-pair token counts against the public library on the same vocabulary file."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quarrymind.functions import bpe
from quarrymind.operators import chunking, documents

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokens(spark):
    return bpe.BytePairs(spark, PATH)


HARD = [None, "", " ", "a", "  a  b ", "it's I'll they'RE", "日本語 🙂🙂 ünï", "x\n\n\ny \t z", "1234 5,678.90", "\x00\x1c\x85\xa0", "<|endoftext|>", "q" * 3000, "\U0010ffff", "ﬁ Å é"]


def test_counts_equal_the_library(spark, tokens, library):
    draw = random.Random(3)
    letters = ["a", "the", "Tok", " ", "  ", "\n", "\t", "é", "日", "🙂", "'s", "1", ".", "\r", "ß", "-", "qu", "ing"]
    rows = list(enumerate(HARD + ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(500)]))
    got = documents.with_token_count(spark.createDataFrame(rows, "id long, text string").repartition(3), tokens=tokens).collect()
    assert {r.id: r.token_count for r in got} == {i: len(library.encode_ordinary(t or "")) for i, t in rows}


def test_counts_of_all_given_documents(spark, tokens, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.token_count for r in documents.with_token_count(docs, tokens=tokens).collect()}
    assert got == {r.doc_id: len(library.encode_ordinary(r.text)) for r in docs.collect()}


def plain_cut(library, text, most, strategy):
    ids, mark = library.encode_ordinary(text or ""), "..."
    if len(ids) <= most:
        return text or ""
    keep = most - len(library.encode_ordinary(mark))
    if keep <= 0:
        return mark
    if strategy == "end":
        return library.decode(ids[:keep]) + mark
    if strategy == "start":
        return mark + library.decode(ids[-keep:])
    return library.decode(ids[: keep // 2]) + mark + library.decode(ids[-(keep - keep // 2) :])


@pytest.mark.parametrize("strategy", ["end", "start", "middle"])
@pytest.mark.parametrize("most", [1, 2, 7, 60])
def test_truncation_equals_the_library(spark, tokens, library, strategy, most):
    rows = list(enumerate([*HARD, "Some words of a sentence that is cut somewhere, 日本語の文章 🙂."]))
    got = documents.truncate(spark.createDataFrame(rows, "id long, text string"), most, strategy, tokens=tokens).collect()
    assert {r.id: r.text for r in got} == {i: plain_cut(library, t, most, strategy) for i, t in rows}
    with pytest.raises(ValueError):
        tokens.cut("text", 5, "sideways")


def plain_chunks(library, text, size, overlap):
    """Whole sentences up to ``size`` tokens; a new chunk starts with the sentences at the end of the last one that fit ``overlap``."""
    parts = [s.strip() for s in __import__("re").split(r"(?<=[.!?])\s+", text) if s.strip()]
    chunks, now, used = [], [], 0
    for part in parts:
        cost = len(library.encode_ordinary(part))
        if used + cost > size and now:
            chunks.append(" ".join(now))
            tail, kept = [], 0
            for back in reversed(now):
                more = len(library.encode_ordinary(back))
                if kept + more > overlap:
                    break
                tail.insert(0, back)
                kept += more
            now, used = tail, kept
        now.append(part)
        used += cost
    return chunks + ([" ".join(now)] if now else [])


def test_chunks_hold_the_library_s_tokens(spark, tokens, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {(r.doc_id, n): c for r in docs.collect() for n, c in enumerate(plain_chunks(library, r.text, 96, 24))}
    got = chunking.chunk_overlapping(docs, size=96, overlap=24, tokens=tokens).collect()
    assert {(r.doc_id, r.chunk_index): r.content for r in got} == want
    assert all(r.token_count == len(library.encode_ordinary(r.content)) for r in got)
    flat = chunking.simple_chunk(docs, size=96, overlap=24, tokens=tokens).collect()
    assert {(r.doc_id, r.chunk_index): (r.content, r.token_count) for r in flat} == {k: (c, len(library.encode_ordinary(c))) for k, c in want.items()}


def test_sentences_up_to_a_budget(spark, tokens, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def plain(text, most, least):
        if len(library.encode_ordinary(text)) <= most:
            return text
        out, used = [], 0
        for i, part in enumerate(__import__("re").split(r"(?<=[.!?])\s+", text)):
            cost = len(library.encode_ordinary(part))
            if used + cost > most and i >= least:
                break
            out.append(part)
            used += cost
        return " ".join(out)

    got = documents.truncate_sentences(docs, 50, 2, tokens=tokens).collect()
    assert {r.doc_id: r.text for r in got} == {r.doc_id: plain(r.text, 50, 2) for r in docs.collect()}


def test_counting_needs_no_shuffle(spark, tokens):
    plan = documents.with_token_count(spark.range(5).select(F.col("id").cast("string").alias("text")), tokens=tokens)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3000)
    own = bpe.Pieces({library.decode_single_token_bytes(i): i for i in range(50_256)}, bpe.PATTERN)
    for n in range(500):
        text = f"piece{n} and more{n}"
        assert own.count(text) == len(library.encode_ordinary(text))
        assert len(own.known) < 40
