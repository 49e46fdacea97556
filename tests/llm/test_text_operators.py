"""Operators that map over rows, against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard  # noqa: F401

from quarrymind.llm import codes, licenses, media, pages, pieces, private, quality

P = pytest.importorskip("public_tokenizers")


def by_text(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


# ---- media ----

@pytest.mark.parametrize("data", [b"", b"abc", b"x" * 64, b"y" * 65, bytes(range(256)) * 40, b"\xff" * 3000, "é".encode() * 5000])
def test_media_is_lossless(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    movie, frames = media.read_avi(media.write_avi(payload))
    assert media.payload_of(movie, frames) == payload
    found = media.clips(frames, movie.frame_us)
    assert found[0].first_frame == 0 and found[-1].last_frame == len(frames) - 1
    assert all(a.last_frame + 1 == b.first_frame and a.end_ms == b.start_ms for a, b in zip(found, found[1:]))


def test_a_change_of_content_is_a_cut():
    movie, frames = media.read_avi(media.write_avi(media.padded(b"a" * 8192 + b"Z" * 8192)))
    assert [(c.first_frame, c.last_frame) for c in media.clips(frames, movie.frame_us)] == [(0, 7), (8, 15)]


def test_media_rejects_other_files():
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF....WAVE")
    image = bytearray(media.frame(np.zeros((1, 64), np.uint8)))
    image[image.index(b"\xff\xdd") + 5] = 2
    with pytest.raises(ValueError):
        media.read_frame(bytes(image))


def test_media_rows(spark, edge):
    got = media.describe(media.to_media(edge)).collect()
    assert len(got) == edge.count()
    texts = {r.doc_id: (r.text or "").encode() for r in edge.select("doc_id", "text").collect() if r.doc_id}
    for r in got:
        if r.doc_id:
            payload = media.padded(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    by = {}
    for r in got:
        if r.doc_id:
            by.setdefault(texts[r.doc_id], set()).add((r.media_sha256, str(r.clips)))
    assert all(len(v) == 1 for v in by.values())
    assert media.clip_rows(media.describe(media.to_media(edge))).count() >= edge.count()


# ---- pages ----

PAGES = {
    "": "",
    "plain words": "plain words",
    "<article><p>One &lt;b&gt; a&nbsp;b<p>Two<br>three <b>fo</b>ur</article><p>unclosed <a href='x' title='a>b'>x</a": "One <b> a b\nTwo three four",
    "<nav>menu<article><p>Text in the article</p></article>": "Text in the article",
    "<div class='ad'><p>x</div><main><h1>T</h1>raw text <aside>side</aside> more</main>": "T\nraw text\nmore",
    "<head><title>No</title></head><body><article><h1>T</h1><p>Short.</p><form><p>Name</p></form><script>var a='</p>';</script>"
    "<div class='comments'><p>I think that this is the best of all the things that there are</p></div></article><footer>&copy; me</footer>": "T\nShort.",
    "<body><div id='header'><h1>Site</h1></div><div class='content'><h2>Title</h2><p>The cat is on the mat and that is all there is to say about "
    "this matter for now.</p><p>Ok.</p></div><div class='sidebar'><p>The cat is on the mat</p></div><section id='comments'><article class='comment'>"
    "<p>I think that this is</p></article></section>": "Title\nThe cat is on the mat and that is all there is to say about this matter for now.\nOk.",
    "<!-- <p>no</p> --><article><p>yes<!-- no --> it is</p><ul><li><a href=/a>one link</a></li><li>an item</li></ul></article>": "yes it is\nan item",
    "<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p><p class='cookie-notice'>no</p></article>": "yes",
    "<p>abc < d": "abc < d",
    "<body class='has-sidebar'><div class='page with-sidebar no-comments'><header><h1>Site</h1></header><article class='post'><header class='post-header'><h1>Title</h1></header>"
    "<div class='entry-header'>Lead.</div><p>Body text.</p><blockquote>A quote.</blockquote><table><tr><td>a</td><td>b</td></tr></table><div class='share-links'><a>share</a></div></article>"
    "<div id='comments'><p>I think that it is so and that the rest of it is not</p></div><aside>More</aside></div></body>": "Title\nLead.\nBody text.\nA quote.\na\nb",
    "<div class='topbar'>menu</div><div class='article-body'><h1>T</h1><p>Short.</p><p>Shorter.</p></div><div class='footer'>(c) us</div>": "T\nShort.\nShorter.",
    "<div class='cookieNotice'><p>We use cookies to make this site work for all of you and for the best of it</p></div><main class='menu-page'><p>Hello.</p></main>": "Hello.",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert pages.main_text(html) == PAGES[html]


def test_pages_of_the_table(spark):
    """The given pages are regular, so a plain cut gives their text."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    got = pages.extract(table).collect()
    assert len(got) == len(html)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(pages.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_edges(spark):
    rows = [(1, "u", None), (None, None, ""), (1, "u", None), (2, "u", "<p " * 20_000), (3, "u", "<a title=\"" * 20_000), (4, "u", "<!--" * 20_000), (5, "u", "<div>" * 20_000 + "deep")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars"))
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, ""), (1, ""), (2, ""), (3, ""), (4, ""), (5, "deep")]


# ---- private data ----

def plain_spans(text):
    out = [("email", *m.span()) for m in private.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in private.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in private.CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        odd, even = [int(d) for d in digits[-1::-2]], [2 * int(d) for d in digits[-2::-2]]
        if 12 <= len(digits) <= 19 and sum(odd + [d - 9 if d > 9 else d for d in even]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in private.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], private.KINDS.index(s[0])))


def test_patterns_equal_plain_search():
    draw = random.Random(1)
    for _ in range(5000):
        text = "".join(draw.choice("a1.2@-+ 4.5_0()") for _ in range(40))
        assert [(s.kind, s.start, s.end) for s in private.pattern_spans(text)] == plain_spans(text), text
    assert private.pattern_spans("9" * 100_000 + "a" * 100_000 + "@") == []


@pytest.fixture(scope="module")
def field():
    return private.train(private.labelled_lines())


def test_field_fits_and_decodes_best_path(field):
    lines = private.labelled_lines()
    shapes = [np.array([private.shape(w) for w in words]) for words, _ in lines]
    right = sum([private.TAGS[t] for t in private.viterbi(field, s[None, :])[0]] == tags for s, (_, tags) in zip(shapes, lines))
    assert right >= 0.9 * len(lines)
    # Padding changes nothing, and no other path of a short line scores higher.
    width = max(map(len, shapes))
    padded = np.array([np.pad(s, (0, width - len(s))) for s in shapes])
    scores = private.emissions(field, padded)
    from itertools import product

    s = next(s for s in shapes if len(s) == 4)
    best = private.viterbi(field, s[None, :])[0]
    e = private.emissions(field, s[None, :])[0]

    def score(path):
        return field.start[path[0]] + sum(e[i, t] for i, t in enumerate(path)) + sum(field.transition[a, b] for a, b in zip(path, path[1:]))

    assert score(best) >= max(score(p) for p in product(range(len(private.TAGS)), repeat=len(s))) - 1e-9
    assert scores.shape[0] == len(lines)


def test_field_generalises(field):
    shapes = private.Shapes()
    said = [
        "nd password=f00dfeedbeef0123 in", "x token = \"deadbeef0123456789abcdef01234567\" y", "call (415) 555-2671 now", "plain words only here", "In 1999 there were 12 of 30.", "w12 w3 w400 7 8 9"
    ]
    kinds = [[s.kind for s in both] for _, both in private.all_spans(said, field, shapes)]
    assert kinds == [["secret"], ["secret"], ["phone"], [], [], []]


def test_private_rows(spark, docs, edge, field):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in private.find(docs, field).collect():
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == plain_spans(text[r.doc_id])
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], private.ORDER.index(s[0]), s[2]))
    assert private.find(edge, field).count() == edge.count()
    clean = private.redact(edge, field)
    assert clean.columns == edge.columns and clean.dtypes == edge.dtypes
    assert sorted(map(str, clean.collect())) == sorted(map(str, edge.collect()))
    one = spark.createDataFrame([(1, "mail a@b.example.com and 4111 1111 1111 1111 here", 50)], "doc_id long, text string, n_chars long")
    assert tuple(private.redact(one, field).first()) == (1, "mail [EMAIL] and [CARD] here", 28)


def test_long_lines_are_decoded_whole(field):
    text = "the " * 3000 + "password=e1c093f22d3955eaac " + "of " * 3000 + "7 8 9"
    (_, both), = private.all_spans([text], field, private.Shapes())
    assert [s.kind for s in both] == ["secret"] and text[both[0].start : both[0].end] == "password=e1c093f22d3955eaac"
    # Wherever a span stands in a line, at the edge of what is scored at once too, it is found whole.
    said = ["the " * n + "call (212) 555-0143 " + "of " * 40 for n in [*range(440, 530), *range(1015, 1030)]]
    for text, (_, both) in zip(said, private.all_spans(said, field, private.Shapes())):
        assert [text[s.start : s.end] for s in both] == ["(212) 555-0143"]


def test_paths_do_not_depend_on_other_lines(field):
    """Lines decoded together, alone, in small blocks and in small steps, against the plain recurrence."""
    draw = random.Random(6)
    words = [w for line, _ in private.labelled_lines() for w in line] + ["the", "of"] * 100
    lines = [np.array([private.shape(draw.choice(words)) for _ in range(draw.choice([1, 2, 9, 60, 700]))]) for _ in range(30)]

    def plain(bits):
        scores = private.emissions(field, bits[None, :])[0]
        best, back = field.start + scores[0], []
        for row in scores[1:]:
            through = best[:, None] + field.transition
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    padded = np.array([np.pad(x, (0, 700 - len(x))) for x in lines])
    for x, tags in zip(lines, private.viterbi(field, padded)):
        assert tags[: len(x)].tolist() == plain(x) == private.viterbi(field, x[None, :])[0].tolist()


# ---- licenses ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text, rules):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    base = [(i, p) for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    line = " " + " ".join(words) + " "
    spans = []
    for n, r in enumerate(rules):
        if f" {r.keyword} " in line:
            for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                spans.append((start, start + m[0].count(" ") + 1, r.priority, n, r.label, r.weight))
    spans.sort(key=lambda s: (s[0], -s[1], s[2], s[3]))
    kept = [s for i, s in enumerate(spans) if not any(o[2] <= s[2] and o[1] >= s[1] for o in spans[:i])]
    labels = {licenses.BASE[p] for _, p in base}
    starts = [i for i, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {s[4] for s in kept})), max((s[5] for s in kept), default=0.0),
    )


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc-by CC  by", "all rights reserved. ALL RIGHTS RESERVED", "GNU General Public License, version 3",
    "released under the terms of the GNU Lesser General Public License v2.1", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later",
    "generał public license", "the cc by by cc by", "MIT License; BSD 3-Clause License; unlicense", "no licence here, copyright 2019 2020 someone", "éall rights reservedé",
    "Creative Commons Attribution ShareAlike 3.0", "licensed under cc by nc sa 2 5 all rights reserved",
]


def test_licenses_equal_plain_scan(spark, docs, edge):
    rules = licenses.signatures()
    assert len(rules) > 300
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(100 + i, " filler ".join(LICENSED[i::3])) for i in range(3)]
    rows += [(1000 + r.doc_id, r.text) for r in docs.collect()]
    rows += [(-1 - i, r.text) for i, r in enumerate(edge.collect())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *plain_scan(t, rules)) for i, t in rows)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert by_text(licenses.scan(table), *columns) == sorted(want, key=repr)


def test_license_scan_stays_out_of_python(docs):
    import contextlib
    import io

    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        licenses.scan(docs).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", said.getvalue())


# ---- token ids ----

def test_codes_address_each_id():
    draw = random.Random(3)
    for n in (0, 1, 5, 511, 512, 513, 3000):
        ids = np.array([draw.choice([0, 5, 255, 256, 70_000, 2**32 - 1, draw.randrange(60_000)]) for _ in range(n)], np.uint32)
        packed = codes.Codes(codes.pack(ids))
        assert len(packed) == n and [packed[i] for i in range(n)] == ids.tolist()
        for _ in range(20):
            a = draw.randint(0, n)
            b = draw.randint(a, n)
            assert packed.run(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        packed[n]


PARTS = ["a", "b ", "  ", " ", "\n", "\t", "'s", " 're", "é", "1", "23", "!!", "?", "\x1c", "\x85", "<|endoftext|>", "you", "\r\n", "🙂", "x.", "y,", "..", "\n\n", " \n"]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole, own, draw = Tokenizer.from_file(path), codes.Encoder(path), random.Random(9)
    assert own(["a <|endoftext|> b"])[0].tolist() == whole.encode("a <|endoftext|> b", add_special_tokens=False).ids and 50256 in own(["a <|endoftext|> b"])[0]
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 9))) for _ in range(6000)]
    for i in range(0, len(texts), 100):
        for text, got in zip(texts[i : i + 100], own(texts[i : i + 100])):
            assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_files_of_codes(spark, docs, edge, nothing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = codes.read(codes.write(docs, codes.byte_bpe(path)))
    assert sorted(map(tuple, got.collect())) == want
    odd = codes.read(codes.write(edge, codes.byte_bpe(path))).collect()
    assert len(odd) == edge.count()
    ordered = sorted(odd, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id is None for r in ordered[:2]] == [True, True]
    assert codes.read(codes.write(nothing, codes.byte_bpe(path))).count() == 0


# ---- pieces ----

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's unigram model over the same pieces and scores."""
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    for own, scored in zip(model.pieces, pieces.zipf_scores(pieces.read_model(path))):
        assert own.piece == scored.text
        own.score = scored.score
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_pieces_equal_the_library(vocabulary, library, docs):
    draw, encode = random.Random(5), pieces.Encoder(vocabulary)
    texts = ["", " ", "a", " a", "a ", "\n", "\n\n", "a\n b", "a \nb", "  x", "Hello  wörld\n x", "▁a▁", "日本語テスト", "\t tab", "🙂🙂 ok", "x" * 300, "foo\n", "\nfoo bar"]
    texts += ["".join(draw.choice(["the", "ing ", "  ", " ", "\n", "é", "zq", "12", "▁", "🙂", "ü ", "Th", " a"]) for _ in range(draw.randint(0, 10))) for _ in range(2000)]
    texts += [r.text for r in docs.collect()]
    fallback = set(vocabulary.byte_ids.tolist())

    def score(ids):
        return sum(vocabulary.scores[i] for i in ids if i not in fallback)

    for i in range(0, len(texts), 50):
        for text, got in zip(texts[i : i + 50], encode(texts[i : i + 50])):
            want = library.encode(text)
            # The library sums in single precision, so only near ties may differ.
            assert got.tolist() == want or abs(score(got) - score(want)) < 1e-4 * max(1, len(want)), text
            assert pieces.MARK in text or vocabulary.decode(got.tolist()) == text
            assert vocabulary.decode(want) == library.decode(want)


def test_trie_finds_exactly_its_words():
    words = {"a": 0, "ab": 1, "abc": 2, "b": 3, "cab": 4, "zé": 5}
    trie = pieces.build_trie(words)

    def find(word):
        state = 0
        for c in word:
            code = trie.codes.get(c, 0)
            ahead = trie.base[state] + code
            if not code or trie.check[ahead] != state:
                return -1
            state = ahead
        return trie.value[state]

    assert all(find(w) == n for w, n in words.items()) and find("ca") == find("x") == find("abcd") == -1


def test_piece_rows(spark, vocabulary, edge, nothing):
    got = pieces.encode(edge, vocabulary).collect()
    assert len(got) == edge.count() and sum(not r.lossless for r in got) == 1  # the text that holds the marker
    assert all(r.n_tokens == len(r.ids) for r in got)
    more = pieces.add_ids(edge, vocabulary)
    assert more.columns == [*edge.columns, "token_ids", "decoded"] and more.count() == edge.count()
    assert pieces.encode(nothing, vocabulary).count() == 0 and pieces.add_ids(nothing, vocabulary).count() == 0


# ---- quality ----

def test_ranking_separates_held_out_rows(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op9_quality_ranking"](spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_ranking_ignores_labels_of_other_classes(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7), (1, 1)], "doc_id long, quality int")
    ranker = quality.fit(edge, labels)
    assert {r.score for r in quality.scores(edge, ranker).collect()} == {0.5}
    assert quality.scores(edge, ranker).count() == edge.count() and quality.scores(nothing, ranker).count() == 0
    both = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (8, 1)], "doc_id long, quality int")
    kept = quality.keep_good(edge, quality.fit(edge, both))
    assert kept.columns == edge.columns and kept.count() <= edge.count()


def test_newton_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.0] + draw.normal(size=300) > 0).astype(int)
    ranker = quality.fit_pairs(x, y, 0.7)
    worth = x @ np.array(ranker.weights)
    pairs = (worth[y == 1][:, None] > worth[y == 0][None, :]).mean()
    assert pairs > 0.85 and abs(np.mean(ranker.score(x) < 0.7) - np.mean(y == 0)) < 0.01
