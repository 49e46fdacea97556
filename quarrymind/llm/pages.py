"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block alone, by link density, length and
stop-word density; blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are bad by
their container. Short blocks, and blocks whose density says little, stay undecided. Pass two gives each of these the
label of its nearest decided neighbour, within its own container first. Good blocks are joined in page order.

Pages are handled one by one inside a scan: no shuffle. Null or empty pages give an empty text, pages without markup are
one block. Unclosed tags, quotes and comments end where the next construct begins. Repeated rows are
extracted one by one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrymind.llm.common import blank, read_table, slices, texts

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more
    no not of on one or our she so than that the their them there they this to was we were what when which who will with you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach
    nicht noch nur oder sich sie sind so über um und uns von vor war wenn wie wir zu zum zur
    au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous ont ou où par pas plus pour que
    qui sa se ses son sont sur un une vous
    al como con del el ella ellos era es esta este fue ha hay lo los más me mi muy nos o para pero por porque se si sin
    sobre su sus también tiene todo una unos y ya""".split()
)

# How tags, class names and roles of HTML pages are used.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe object svg math canvas audio video select head".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog button fieldset search".split())
MAIN_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox banner outbrain taboola sponsor sponsored promo promotion
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer foot
    sidebar aside widget widgets rail notice notices cookie cookies consent gdpr alert popup modal overlay dialog
    comment comments commentlist disqus respond responses replies reply discussion guestbook paywall form login signin signup register search newsletter
    subscribe subscription share sharing social related recommended trending copyright colophon skip""".split()
)
# A class such as has-sidebar or no-comments says what a page is laid out with, not what an element holds.
LAYOUT_WORDS = frozenset("no not has have with without hide hidden show is".split())
MAIN_NAMES = (frozenset("article post story entry main page".split()), frozenset("content body text copy".split()))
MAIN_IDS = frozenset("content main article story maincontent".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^<>]*(?:>|(?=<)|\Z))""",
    re.S | re.X,
)
ATTR = re.compile(r"""([A-Za-z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


class Rules(NamedTuple):
    """Bounds of the first pass; lengths in characters."""

    short: int = 70
    long: int = 200
    few_stops: float = 0.05
    many_stops: float = 0.15
    links: float = 0.2
    links_inside: float = 0.5


class Block(NamedTuple):
    text: str
    linked: int
    bad: bool
    inside: int
    heading: bool


def is_bad(tag: str, attrs: str, inside: bool) -> bool:
    """Does this element hold something other than the article? A header inside an article heads the article."""
    if tag in BAD_TAGS and not (tag == "header" and inside):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and tag not in ("body", "html", "main") and not (inside and tag == "header"):
            for one in value.split():
                names = set(NAME.findall(CAMEL.sub(" ", one).lower()))
                bad = names & BAD_NAMES - ({"header"} if inside else set())
                if bad and not names & LAYOUT_WORDS:
                    return True
        elif key == "role" and value.lower() in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and HIDDEN.search(value):
            return True
    return False


def is_main(tag: str, attrs: str) -> bool:
    """Does a container's name say that it holds the article? Asked only on pages without article or main elements."""
    if tag not in ("div", "section", "td") or "=" not in attrs:
        return False
    for key, value in ATTR.findall(attrs):
        names = NAME.findall(CAMEL.sub(" ", value).lower())
        if key.lower() == "id" and "".join(names) in MAIN_IDS or key.lower() in ("class", "id") and all(not m.isdisjoint(names) for m in MAIN_NAMES):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with link characters, container and whether the container is bad."""
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, bad, number of the article around
    links = articles = linked = at = 0
    heading = False
    lower = html.lower()
    open_tags = Counter(m for m in re.findall(r"<(nav|header|footer|aside|form|menu|dialog|div|section)\b", lower))
    closed = {tag: lower.count("</" + tag) for tag in open_tags}
    named = not re.search(r"<(?:article|main)\b", lower)

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, linked, *state(), heading))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if links:
                linked += len("".join(text.split()))

    while token := TOKEN.search(html, at):
        say(html[at : token.start()])
        at = token.end()
        if token["tag"] is None:
            if html.startswith("<![CDATA[", token.start()):
                say(token[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = token["tag"].lower(), token["attrs"]
        if token["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCK_TAGS:
                flush()
                heading = False
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if tag not in BLOCK_TAGS and stack[depth][1] != state()[0]:
                    flush()
                if tag in BLOCK_TAGS or depth == len(stack) - 1:
                    del stack[depth:]
            continue
        if tag in RAW_TAGS:
            if not attrs.endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\s*>").search(lower, at)
                at = (close.start() if close and close[0].startswith("<body") else close.end()) if close else len(html) if tag in ("script", "style") else at
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            links = 1
        if tag in BLOCK_TAGS:
            flush()
            links = links if tag not in ("p", "li", "div", "section", "article") else 0
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()
        if tag in VOID_TAGS or attrs.endswith("/>"):
            continue
        bad, inside = state()
        if tag in MAIN_TAGS or named and not inside and not bad and is_main(tag, attrs):
            # A container that is never closed does not swallow the article.
            while bad and stack and open_tags[stack[-1][0]] > closed.get(stack[-1][0], 0):
                stack.pop()
                bad, inside = state()
            if not inside:
                articles += 1
                inside = articles
        if tag in BLOCK_TAGS or "=" in attrs:
            own = is_bad(tag, attrs, bool(inside))
            if own and not bad and tag not in BLOCK_TAGS and tag != "a":
                flush()
            if tag in BLOCK_TAGS or own and tag != "a":
                stack.append((tag, bad or own, inside))
    say(html[at:])
    flush()
    return found


def first_pass(block: Block, rules: Rules) -> str:
    """Label of a block by itself."""
    size = len(block.text)
    chars = size - block.text.count(" ")
    density = block.linked / chars if chars else 0.0
    if block.bad or density > (rules.links_inside if block.inside else rules.links) or "©" in block.text and size < rules.long and not block.inside:
        return BAD
    if size < rules.short:
        return BAD if block.linked and not block.inside else SHORT
    words = [w.strip(".,;:!?()\"'%#$&*|").lower() for w in block.text.split()]
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops >= rules.many_stops:
        return GOOD if size > rules.long or block.inside else NEAR
    if stops >= rules.few_stops or block.inside:
        return NEAR
    return BAD


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block, of their own container if it has one."""
    n = len(found)
    decided = [i for i in range(n) if labels[i] in (GOOD, BAD)]
    homes = {b.inside for b in found if b.inside and not b.bad}

    def nearest(order: range, same: bool) -> list[int | None]:
        out: list[int | None] = [None] * n
        last: dict[int, int] = {}
        for i in order:
            home = found[i].inside if same else 0
            out[i] = last.get(home)
            # Menus and adverts between an article's blocks say nothing about the article.
            if labels[i] in (GOOD, BAD) and not (same and found[i].bad):
                last[home] = i
        return out

    near = {same: (nearest(range(n), same), nearest(range(n - 1, -1, -1), same)) for same in (True, False)}
    good_homes = {b.inside for b, label in zip(found, labels) if label == GOOD}
    kept = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            kept.append(label == GOOD)
            continue
        home = found[i].inside
        before, after = near[True][0][i], near[True][1][i]
        if home and (home not in good_homes or found[i].heading and before is None):
            # An article of short blocks is good as it stands, and so is its title.
            kept.append(True)
            continue
        if before is None and after is None:
            if not decided or not homes and not any(labels[k] == GOOD for k in decided):
                kept.append(True)
                continue
            before, after = near[False][0][i], near[False][1][i]
        sides = {labels[k] for k in (before, after) if k is not None}
        if len(sides) == 1:
            kept.append(sides == {GOOD})
        elif found[i].heading:
            kept.append(labels[after] == GOOD)
        elif label == NEAR:
            kept.append(True)
        else:
            kept.append(labels[before if i - before <= after - i else after] == GOOD)
    return kept


def main_text(html: str, rules: Rules = Rules()) -> str:
    found = blocks(html)
    kept = second_pass(found, [first_pass(b, rules) for b in found])
    return "\n".join(b.text for b, good in zip(found, kept) if good)


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """The given id columns, ``text`` (empty where nothing is good) and ``n_chars``, one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [main_text(html, rules) for html in texts(batch, "_html")]
            columns = [batch.column(c) for c in id_cols]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*id_cols, "text", "n_chars"])

    ids = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return pages.select(*id_cols, blank(html_col).alias("_html")).mapInArrow(run, f"{ids}, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op10_main_text": op10_main_text}
ORACLES: dict[str, str] = {}
