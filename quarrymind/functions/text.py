"""Text rules as column expressions.

Patterns follow Unicode word and space classes (``(?U)``) and treat only ``\\n`` as a
line end (``(?d)``), so results do not depend on the JVM's ASCII defaults.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TokenEstimator = Callable[[Column], Column]

# Spanish and English words ignored by keyword extraction.
STOP_WORDS = [
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "al", "a", "en", "con", "por", "para", "que",
    "es", "son", "fue", "ser", "está", "están", "y", "o", "pero", "si", "no", "como", "más", "menos", "the", "a",
    "an", "is", "are", "was", "were", "be", "to", "of", "and", "or", "in", "on", "at", "for", "with", "this", "that",
    "it", "as", "by", "from",
]

# HTML entities, replaced in this order.
HTML_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
]

# Markdown marks removed in this order, as (pattern, replacement).
MARKDOWN_STEPS = [
    (r"(?sU)```[\w]*\n(.*?)\n```", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"(?mdU)^#{1,6}\s*", ""),
    (r"(?mdU)^>\s*", ""),
    (r"(?mdU)^[\*\-\+]\s+", "• "),
    (r"(?mdU)^\d+\.\s+", "• "),
    (r"(?mdU)^[-*_]{3,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
    (r" +", " "),
]

NO_TITLE = "Sin título"

# The characters of Unicode's class of white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A pattern of what compatibility normalisation may change; Latin letters with marks and the like are left as they are, next to each other too.
CHANGEABLE = r"[\xA0\xA8\xAA\xAF\xB2\xB3\xB4\xB5\xB8\xB9\xBA\xBC\xBD\xBE[^\x00-\u0131]]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def words(c: Column | str) -> Column:
    """Runs of non-space characters, empty pieces dropped."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(c: Column | str) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(_col(c)) / 4).cast("int")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """Compatibility-normalise; only rows with characters that this may change travel to Python."""
    text = _col(c)
    return F.coalesce(_nfkc(F.when(text.rlike(CHANGEABLE), text)), text)


def clean_whitespace(c: Column | str) -> Column:
    """Strip every line and keep at most one empty line in a row."""
    out = F.regexp_replace(_col(c), r"(?U)(?<![^\S\n])[^\S\n]++(?=\n)", "")
    out = F.regexp_replace(out, r"(?U)(?<=\n)[^\S\n]++", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalize(c: Column | str) -> Column:
    out = F.regexp_replace(nfkc(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return clean_whitespace(F.regexp_replace(out, "[–—]", "-"))


def strip_markdown(c: Column | str) -> Column:
    out = _col(c)
    for pattern, replacement in MARKDOWN_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def clean_text(c: Column | str) -> Column:
    """Normalise and then drop markdown marks."""
    return strip(strip_markdown(normalize(c)))


def normalize_markdown(c: Column | str) -> Column:
    out = F.regexp_replace(normalize(c), r"(?mdU)^(#{1,6})\s*", "$1 ")
    return F.regexp_replace(out, r"(?mdU)^(\s*)[-*+](\s+)", "$1- ")


def html_to_raw_text(c: Column | str) -> Column:
    """Tags to plain marks and entities to characters, before normalisation."""
    out = _col(c)
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    for tag, replacement in (
        ("h1", "# $1\n"), ("h2", "## $1\n"), ("h3", "### $1\n"), ("p", "$1\n\n"),
    ):
        out = F.regexp_replace(out, rf"(?i)<{tag}[^>]*>([^<]+)</{tag}>", replacement)
    out = F.regexp_replace(out, r"(?iU)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>([^<]+)</li>", "- $1\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_to_text(c: Column | str) -> Column:
    return normalize(html_to_raw_text(c))


def title(c: Column | str) -> Column:
    """First level-1 heading, else the <title>, else the first line over five characters."""
    text = _col(c)
    # A plain search for what a pattern cannot do without costs far less than the pattern.
    heading = F.when(F.contains(text, F.lit("#")), F.regexp_extract(text, r"(?mdU)^#\s+(.+)$", 1))
    html_title = F.when(F.contains(text, F.lit("<")), F.regexp_extract(text, r"(?i)<title>([^<]+)</title>", 1))
    line = F.nullif(F.regexp_extract(text, r"(?dU)(?:^|\n)[^\S\n]*(\S[^\n]{4,}\S)", 1), F.lit(""))
    cut = F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(
        F.coalesce(
            F.when(F.length(heading) > 0, strip(heading)),
            F.when(F.length(html_title) > 0, strip(html_title)),
            cut,
            F.lit(NO_TITLE),
        )
    )


def title_from_path(path: Column | str) -> Column:
    """File stem with separators as spaces, each word capitalised."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def _ends(c: Column, extensions: str) -> Column:
    return c.rlike(rf"\.({extensions})$")


def content_type(content: Column, path: Column | None = None, url: Column | None = None) -> Column:
    """Kind of content from the URL, else the file name, else the content itself."""
    path = F.lit(None).cast("string") if path is None else path
    url = F.lit(None).cast("string") if url is None else url
    url_path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    name = F.lower(path)
    has = lambda *parts: reduce(Column.__or__, [F.contains(content, F.lit(p)) for p in parts])
    bulleted = has("\n-", "\n*", "\n+") | F.substring(content, 1, 1).isin("-", "*", "+")
    # Marks that suggest markdown; two different ones are needed. Patterns are tried on texts that hold what they cannot do without.
    marks = [
        has("#") & content.rlike(r"(?mdU)^#{1,6}\s"), has("**") & content.rlike(r"\*\*[^*]+\*\*"), has("](") & content.rlike(r"(?d)\[.+\]\(.+\)"),
        bulleted & content.rlike(r"(?mdU)^[-*+]\s"), has("```"),
    ]
    n_marks = sum((m.cast("int") for m in marks), F.lit(0))
    is_web = url.rlike(r"^(?i)https?://")
    return (
        F.when(
            is_web,
            F.when(_ends(url_path, "pdf"), "pdf")
            .when(_ends(url_path, "mp3|wav|m4a|ogg"), "audio")
            .when(_ends(url_path, "mp4|avi|mov|webm"), "video")
            .otherwise("url"),
        )
        .when(_ends(name, "pdf"), "pdf")
        .when(_ends(name, "docx"), "docx")
        .when(_ends(name, "md|markdown"), "markdown")
        .when(_ends(name, "html|htm"), "html")
        .when(_ends(name, "txt|text"), "text")
        .when(_ends(name, "mp3|wav|m4a|ogg|flac"), "audio")
        .when(_ends(name, "mp4|avi|mov|webm|mkv"), "video")
        .when(F.coalesce(F.length(content), F.lit(0)) == 0, "unknown")
        .when(has("<") & content.rlike(r"(?iU)\A\s*(<!doctype|<html|<head|<body)"), "html")
        .when(n_marks >= 2, "markdown")
        .otherwise("text")
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def two_decimals(c: Column | str) -> Column:
    """A non-negative number with two decimals, rounded by its exact binary value, ties to even.

    Java formats the shortest decimal form instead, which moves some values up a cent. The
    fraction times 2**56 (2**60 when it is small) is a whole number, so the rounding is
    done in whole numbers.
    """
    x = _col(c).cast("double")

    def scale(parts: Column) -> Column:
        small = parts["f"] < 0.0625
        hundredfold = (parts["f"] * F.when(small, float(2**60)).otherwise(float(2**56))).cast("bigint") * 100
        return bind(
            F.struct(parts["i"], hundredfold.alias("p"), F.when(small, F.lit(2**60)).otherwise(F.lit(2**56)).alias("unit")), cents
        )

    def cents(parts: Column) -> Column:
        rest = F.pmod(parts["p"], parts["unit"])
        whole = F.when(parts["unit"] == 2**60, F.shiftright(parts["p"], 60)).otherwise(F.shiftright(parts["p"], 56))
        half = F.shiftright(parts["unit"], 1)
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        return bind(parts["i"] * 100 + whole + up.cast("bigint"), shown)

    def shown(n: Column) -> Column:
        return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    return F.when(x.isNotNull(), bind(F.struct(F.floor(x).alias("i"), (x - F.floor(x)).alias("f")), scale))


def keywords(c: Column | str, n: int = 10) -> Column:
    """Most frequent words of three or more characters, ties by first appearance.

    Everything happens inside the row: the (word, position) pairs are sorted, run
    boundaries give counts, and no token is shuffled.
    """
    found = F.filter(
        F.split(F.lower(_col(c)), r"(?U)\W+"),
        lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(set(STOP_WORDS))),
    )
    ranked = F.sort_array(
        F.transform(count_runs(found), lambda r: F.struct((-r["n"]).alias("neg"), r["first"].alias("first"), r["word"].alias("word")))
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["word"])


def count_runs(tokens: Column) -> Column:
    """Array of (word, n, first) for an array of words, by sorting and one pass over the runs."""

    def runs(placed: Column) -> Column:
        """Where each run of equal words starts: elements that differ from their predecessor."""
        before = F.concat(F.array(F.lit(None).cast("struct<word:string,pos:int>")), placed)
        marked = F.zip_with(
            placed,
            F.slice(before, 1, F.size(placed)),
            lambda cur, prev: F.struct(
                cur["word"].alias("word"), cur["pos"].alias("first"),
                (prev["word"].isNull() | (cur["word"] != prev["word"])).alias("edge"),
            ),
        )
        at = F.transform(marked, lambda m, i: F.struct(m["word"], m["first"], i.alias("at"), m["edge"]))
        starts = F.filter(at, lambda m: m["edge"])
        end = F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("first"), F.size(placed).alias("at"), F.lit(True).alias("edge"))
        return bind(F.concat(starts, F.array(end)), lengths)

    def lengths(starts: Column) -> Column:
        return F.zip_with(
            F.slice(starts, 1, F.size(starts) - 1),
            F.slice(starts, 2, F.size(starts) - 1),
            lambda a, b: F.struct(a["word"].alias("word"), (b["at"] - a["at"]).alias("n"), a["first"].alias("first")),
        )

    placed = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    return bind(placed, runs)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of the lower-cased words of two texts; 0 when either has none."""
    return jaccard_sets(F.array_distinct(words(F.lower(_col(a)))), F.array_distinct(words(F.lower(_col(b)))))


def jaccard_sets(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / total).otherwise(F.lit(0.0))


def costs(parts: Column, tokens: TokenEstimator) -> Column:
    """Tokens of each text of an array, by the estimator's own form for arrays if it has one."""
    return tokens.each(parts) if hasattr(tokens, "each") else F.transform(parts, tokens)


def truncate(
    c: Column | str, max_tokens: int, strategy: str = "end", ellipsis: str = "...", tokens: TokenEstimator = estimate_tokens
) -> Column:
    """Cut a text to a token budget at its end, start or middle; the mark's cost is deducted."""
    text = _col(c)
    if hasattr(tokens, "cut"):
        return tokens.cut(text, max_tokens, strategy, ellipsis)
    keep = max_tokens - -(-len(ellipsis) // 4)
    if strategy not in ("end", "start", "middle"):
        raise ValueError(f"unknown truncation strategy: {strategy}")
    if keep <= 0:
        cut = F.lit(ellipsis)
    elif strategy == "end":
        cut = F.concat(F.substring(text, 1, keep * 4), F.lit(ellipsis))
    elif strategy == "start":
        cut = F.concat(F.lit(ellipsis), F.right(text, F.lit(keep * 4)))
    else:
        head = keep // 2
        cut = F.concat(
            F.substring(text, 1, head * 4), F.lit(ellipsis), F.right(text, F.lit((keep - head) * 4))
        )
    return F.when(text.isNull(), F.lit("")).when(estimate_tokens(text) <= max_tokens, text).otherwise(cut)


def sentences(c: Column | str) -> Column:
    parts = F.transform(F.split(_col(c), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def truncate_sentences(
    c: Column | str, max_tokens: int, min_sentences: int = 1, tokens: TokenEstimator = estimate_tokens
) -> Column:
    """Leading whole sentences that fit the budget, never fewer than ``min_sentences``."""
    text = _col(c)
    parts = F.split(text, r"(?U)(?<=[.!?])\s+")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(0).alias("seen"), F.lit(True).alias("open"))

    def step(acc: Column, cost: Column) -> Column:
        fits = acc["open"] & ((acc["used"] + cost <= max_tokens) | (acc["seen"] < min_sentences))
        return F.struct(
            (acc["used"] + F.when(fits, cost).otherwise(0)).alias("used"),
            (acc["kept"] + fits.cast("int")).alias("kept"),
            (acc["seen"] + 1).alias("seen"),
            fits.alias("open"),
        )

    kept = F.aggregate(costs(parts, tokens), start, step, lambda acc: acc["kept"])
    return (
        F.when(text.isNull(), F.lit(""))
        .when(tokens(text) <= max_tokens, text)
        .otherwise(F.array_join(F.slice(parts, F.lit(1), kept), " "))
    )


def split_by(c: Column | str, separators: list[str]) -> Column:
    """Split by each separator in turn, leaving it at the end of the left part; blanks dropped."""
    def split_after(mark: str) -> Callable[[Column], Column]:
        pattern = "(?<=\\Q" + mark + "\\E)"
        return lambda part: F.filter(F.split(part, pattern), lambda s: s != "")

    parts = F.array(_col(c))
    for sep in separators:
        parts = F.flatten(F.transform(parts, split_after(sep)))
    return F.filter(parts, lambda p: p.rlike(r"(?U)\S"))


def clean_query(c: Column | str) -> Column:
    out = F.regexp_replace(strip_markdown(c), r"""[+\-&|!(){}\[\]^"~*?:\\]""", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def snippet(c: Column | str, n: int = 200) -> Column:
    """Leading ``n`` characters, cut at the last space when that lies past 70 % of them."""
    text = _col(c)
    head = F.substring(text, 1, n)
    last_space = F.length(head) - F.locate(" ", F.reverse(head))
    has_space = F.locate(" ", head) > 0
    cut = F.when(has_space & (last_space > n * 0.7), F.left(head, last_space)).otherwise(head)
    return F.when(text.isNull(), F.lit("")).when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def content_hash(c: Column | str) -> Column:
    return F.substring(F.md5(_col(c)), 1, 12)


def highlights(content: Column | str, query: Column | str, context: int = 100, n: int = 3) -> Column:
    """Up to ``n`` distinct passages around the query's terms of three or more characters.

    For one term, splitting on it gives every match offset; terms are taken in query
    order until enough passages are found.
    """
    text, terms = _col(content), F.filter(words(F.lower(_col(query))), lambda t: F.length(t) >= 3)
    lowered = F.lower(text)

    def passage(pos: Column, width: Column) -> Column:
        start = F.greatest(F.lit(0), pos - context)
        end = F.least(F.length(text), pos + width + context)
        return F.concat(
            F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
            F.substring(text, start + 1, end - start),
            F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")),
        )

    def offsets(term: Column) -> Column:
        """0-based starts of the non-overlapping matches of ``term``."""
        lengths = F.transform(F.split(lowered, F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1), lambda p: F.length(p))
        init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(
            F.slice(lengths, 1, F.size(lengths) - 1),
            init,
            lambda acc, gap: F.struct(
                (acc["at"] + gap + F.length(term)).alias("at"),
                F.concat(acc["found"], F.array(acc["at"] + gap)).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    found = F.aggregate(
        terms,
        F.array().cast("array<string>"),
        lambda acc, term: F.when(F.size(acc) >= n, acc).otherwise(
            F.array_distinct(F.concat(acc, F.transform(offsets(term), lambda p: passage(p, F.length(term)))))
        ),
    )
    return F.slice(found, 1, n)
