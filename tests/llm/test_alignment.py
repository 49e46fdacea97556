"""Alignment of two tokenizers against the two libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quarrymind.llm import alignment

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    # The byte alphabet, by asking the tokenizer how it shows each byte of two-byte characters.
    letters = {}
    for point in [*range(0x80), *range(0x80, 0x800)]:
        raw = chr(point).encode()
        for token in (a.pre_tokenizer.pre_tokenize_str("x" + chr(point)) or [("", 0)])[-1:]:
            shown = token[0][-len(raw):]
            letters |= dict(zip(shown, raw))
    for point in (0x800, 0xFFFF, 0x10000, 0x50000, 0x90000, 0xD0000, 0x10FFFF, *range(0x1000, 0xD000, 0x1000), 0xE000):
        raw = chr(point).encode()
        letters |= dict(zip(a.pre_tokenizer.pre_tokenize_str(chr(point))[0][0], raw))
    return a, b, letters


def plain_alignment(libraries, text):
    a, b, letters = libraries
    if not text:
        return None
    whole = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    a_ends, b_ends = np.cumsum([*map(len, a_bytes)]).tolist(), np.cumsum([*map(len, b_bytes)]).tolist()
    cuts = sorted(set(a_ends) & set(b_ends))
    groups = [([], []) for _ in cuts]
    for side, (ids, ends) in enumerate(((a_ids, a_ends), (b_ids, b_ends))):
        at = 0
        for i, end in zip(ids, ends):
            groups[at][side].append(i)
            at += end == cuts[at]
    by_end = dict(zip(b_ends, b_ids))
    links = [(i, by_end[e]) for i, e in zip(a_ids, a_ends) if e in by_end]
    return a_ids, b_ids, groups, links


def plain_rows(libraries, rows):
    seen = {t: plain_alignment(libraries, t) for t in {t for _, t in rows}}
    counts = Counter(link for _, t in rows for link in (seen[t] or ((), (), (), ()))[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for doc, text in rows:
        a_ids, b_ids, groups, links = seen[text] or ((), (), (), ())
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, len(a_ids), len(b_ids), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if a_ids else ""))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(spark, table, folder):
    table.write.parquet(f"{folder}/documents.parquet")
    rows = alignment.op12_token_alignment(spark, str(folder))
    assert rows.columns == NAMES
    return sorted(map(tuple, rows.collect()), key=repr)


HARD = [
    "", " ", "  ", "\n", "\n\n ", "a", " a", "a ", "a  b", "a \n b", "x\ny", "tab\there", "é", "日本語の文章です。", "🙂🙂 👩‍👩‍👧", "mixed 日本 and ünï sep", "<|endoftext|> is text", "<s> <unk> </s>", "<0x41>",
    "a ▁ b", "▁", "\x00", "\x1c x", "a\x85b \xa0 c", "It's they're I'll 's", "x" * 700, "1234567 89,000.50", "　全角", "a\r\nb\r\n\r\nc", "é ﬁ Å", "\U0010ffff", "()();\r end",
]


def test_hard_texts_equal_the_libraries(spark, libraries, tmp_path):
    draw = random.Random(5)
    letters = ["a", "b", "the", "Tok", " ", "  ", "\n", "\t", "é", "日", "🙂", "'s", "1", ".", "\r", " ", "ß", "\x07", "-"]
    rows = list(enumerate(HARD + ["".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(400)] + HARD[:20] + [None]))
    assert found(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tmp_path) == plain_rows(libraries, rows)


def test_coarse_spans_lead_to_the_exact_ends():
    """Tokens inside of a character and fallback bytes: cuts from spans equal those counted in bytes."""
    own = alignment.Aligner(A_PATH, B_PATH)
    segments = [s for text in HARD if text for s in own.cuts.split(" " + text)]
    bad, lengths, parts = own.line_alignments([[s] for s in segments])
    assert [s for s, wrong in zip(segments, bad) if wrong] == [s for s in segments if "▁" in s]
    ends, inside = np.cumsum(lengths, axis=0), 0
    for n, wrong in enumerate(bad):
        x = alignment.Alignment(*(part[e - k : e] for part, e, k in zip(parts, ends[n], lengths[n])))
        if wrong:
            assert not any(map(len, x))
            continue
        a_ends = np.cumsum([len(own.a_bytes[i]) for i in x.a])
        b_ends = np.cumsum([len(own.b_bytes[i]) for i in x.b])
        common = np.intersect1d(a_ends, b_ends)
        assert a_ends[np.cumsum(x.a_sizes) - 1].tolist() == common.tolist() == b_ends[np.cumsum(x.b_sizes) - 1].tolist()
        inside += len(a_ends) > len(common)
    assert inside > 3


def test_given_documents_edges_and_rare_pairs(spark, libraries, docs, edge, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", 50)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(spark, docs, tmp_path / "docs") == plain_rows(libraries, rows)
    extra = edge.withColumns({c: F.lit(1) for c in ("id", "row", "a", "b", "pairs", "times")})
    assert found(spark, extra, tmp_path / "edge") == plain_rows(libraries, [(r.doc_id, r.text) for r in edge.collect()])
    assert found(spark, nothing, tmp_path / "nothing") == []


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBER", 20_000)
    own, free = alignment.Aligner(A_PATH, B_PATH), alignment.Aligner(A_PATH, B_PATH)
    for n in range(30):
        batch = [" ".join(f"w{k * n}" for k in range(50)), "the same text"]
        got, want = own(batch), [alignment.Aligner.__call__(free, [t])[0] for t in batch]
        assert all((x == y).all() for g, w in zip(got, want) for x, y in zip(g, w))
        assert len(own.numbers) < 500


def test_token_ids_and_groups_of_a_table(spark, libraries, edge):
    make = alignment.aligner(A_PATH, B_PATH)
    rows = [(1, "two words"), (2, None), (3, "日本 🙂 x\ny"), (4, "▁")]
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), make).collect():
        want = plain_alignment(libraries, dict(rows)[r.id])
        assert (r.a, r.b, r.a_sizes, r.b_sizes) == ((want[0], want[1], [len(g) for g, _ in want[2]], [len(h) for _, h in want[2]]) if want else ([], [], [], []))
    assert alignment.align(edge, make).count() == edge.count()
