"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words (runs of letters, digits and non-ASCII characters, A-Z lowered) joined by single spaces. Rules are regular
expressions over that string, each with a keyword that must occur before the expression is tried, a priority, a label and
a weight. A match is an interval of words. It is suppressed if a match of a better priority contains it, or one of the same
priority that is longer. What is left gives the labels; the score is the largest weight left (0 without any).

Three base phrases are counted at all places beside the rules; their labels are always in ``labels``.

Only rows with some keyword are normalised. Their matches, not their texts, are shuffled, keyed by row, so no key is larger than
one document's matches. Null texts count as empty; texts without words give 0, nulls and empty strings. Rows that repeat
are scanned one by one, and further columns are ignored.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrymind.llm.common import blank, read_table

# What separates words, and the base phrases with their labels.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    priority: int
    keyword: str
    regex: str
    label: str
    weight: float


class Family(NamedTuple):
    """A license: its label, keyword, names as a pattern over words, versions, and words of its web address."""

    label: str
    keyword: str
    names: str
    versions: tuple[str, ...] = ()
    address: str = ""


# Licenses and how they are named.
FAMILIES = [
    Family("apache", "apache", "apache (?:software )?(?:foundation )?licen[cs]e", ("1.0", "1.1", "2.0"), "apache org licenses(?: license)?"),
    Family("mit", "mit", "(?:mit|expat|mit x11) licen[cs]e", (), "opensource org licen[cs]es mit"),
    Family("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", (), "opensource org licen[cs]es bsd 2 clause"),
    Family("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", (), "opensource org licen[cs]es bsd 3 clause"),
    Family("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    Family("bsd", "bsd", "bsd (?:style )?licen[cs]e"),
    Family("0bsd", "0bsd", "0bsd(?: licen[cs]e)?"),
    Family("isc", "isc", "isc licen[cs]e", (), "opensource org licen[cs]es isc"),
    Family("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    Family("gpl", "gpl", "(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
    Family("gpl", "general", "(?:gnu )?general public licen[cs]e", ("1.0", "2.0", "3.0"), "gnu org licenses(?: old licenses)? gpl"),
    Family("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    Family("lgpl", "lesser", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0"), "gnu org licenses(?: old licenses)? lgpl"),
    Family("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0")),
    Family("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1.0", "3.0"), "gnu org licenses agpl"),
    Family("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", ("1.1", "1.2", "1.3"), "gnu org licenses fdl"),
    Family("mpl", "mozilla", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0"), "mozilla org mpl"),
    Family("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    Family("epl", "eclipse", "eclipse public licen[cs]e", ("1.0", "2.0"), "eclipse org legal epl"),
    Family("edl", "eclipse", "eclipse distribution licen[cs]e", ("1.0",)),
    Family("cddl", "cddl", "cddl", ("1.0", "1.1")),
    Family("cddl", "distribution", "common development and distribution licen[cs]e", ("1.0", "1.1")),
    Family("cpl", "common", "common public licen[cs]e", ("1.0",)),
    Family("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    Family("eupl", "european", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    Family("artistic", "artistic", "(?:perl )?artistic licen[cs]e", ("1.0", "2.0")),
    Family("bsl", "boost", "boost software licen[cs]e", ("1.0",), "boost org license"),
    Family("busl", "business", "business source licen[cs]e", ("1.0", "1.1")),
    Family("sspl", "server", "server side public licen[cs]e", ("1.0",)),
    Family("elastic", "elastic", "elastic licen[cs]e", ("1.0", "2.0")),
    Family("unlicense", "unlicense", "(?:the )?unlicense", (), "unlicense org"),
    Family("wtfpl", "wtfpl", "wtfpl", ("1.0", "2.0")),
    Family("ofl", "font", "(?:sil )?open font licen[cs]e", ("1.0", "1.1"), "scripts sil org ofl"),
    Family("psf", "python", "python (?:software foundation )?licen[cs]e", ("2.0",)),
    Family("php", "php", "php licen[cs]e", ("3.0", "3.01")),
    Family("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    Family("postgresql", "postgresql", "postgresql licen[cs]e"),
    Family("openssl", "openssl", "openssl licen[cs]e"),
    Family("mulan", "mulan", "mulan p(?:ermissive|sl)(?: software license)?", ("1.0", "2.0")),
    Family("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    Family("odbl", "database", "open database licen[cs]e", ("1.0",), "opendatacommons org licenses odbl"),
    Family("odc-by", "attribution", "open data commons attribution licen[cs]e", ("1.0",)),
    Family("pddl", "pddl", "pddl", ("1.0",)),
    Family("cdla", "cdla", "cdla (?:permissive|sharing)", ("1.0", "2.0")),
    Family("openrail", "openrail", "(?:bigscience |creativeml )?(?:open ?rail)(?: m)?(?: licen[cs]e)?"),
    Family("llama", "llama", "llama [0-9](?: [0-9])? community licen[cs]e(?: agreement)?"),
    Family("cc0", "cc0", "cc0", ("1.0",), "creativecommons org publicdomain zero"),
    Family("cc0", "zero", "creative commons zero", ("1.0",)),
]
CC_TERMS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|atives|s)(?: works)?", "sa": "share ?alike"}
CC_KINDS = ("by", "by-nc", "by-nd", "by-sa", "by-nc-nd", "by-nc-sa")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _kind in CC_KINDS:
    _parts = _kind.split("-")
    FAMILIES.append(Family(f"cc-{_kind}", "cc", "cc " + " ".join(_parts), CC_VERSIONS))
    FAMILIES.append(Family(f"cc-{_kind}", "creative", "creative commons " + " ".join(CC_TERMS[p] for p in _parts), CC_VERSIONS))
    FAMILIES.append(Family(f"cc-{_kind}", "creativecommons", "creativecommons org licenses " + " ".join(_parts), CC_VERSIONS))

UNDER = "(?:dual |re)?(?:licensed|released|distributed|available|published|provided|redistributed|covered|used) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:version [0-9]+ of the )?"

# Notices that name no license of the families above.
NOTICES = [
    Rule(5, "rights", "all rights reserved", "reserved", 0.5),
    Rule(4, "rights", "(?:some|no) rights reserved", "some-rights-reserved", 0.5),
    Rule(3, "copyright", "copyright(?: c)?(?: [0-9]{4})+", "copyright-notice", 0.4),
    Rule(5, "copyright", "copyright", "copyright-mention", 0.2),
    Rule(3, "domain", "(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain", "public-domain", 0.9),
    Rule(5, "domain", "public domain", "public-domain", 0.5),
    Rule(2, "warranty", "without warranty of any kind", "warranty-disclaimer", 0.6),
    Rule(2, "merchantability", "warranties of merchantability(?: and)? fitness for a particular purpose", "warranty-disclaimer", 0.6),
    Rule(1, "permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.95),
    Rule(1, "permission", "permission to use copy modify and or distribute this software for any purpose", "isc", 0.95),
    Rule(1, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0.95),
    Rule(1, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 0.95),
    Rule(3, "proprietary", "proprietary and confidential", "proprietary", 0.8),
    Rule(3, "commercial", "(?:for )?non commercial use only", "non-commercial", 0.7),
    Rule(3, "eula", "end user licen[cs]e agreement", "eula", 0.7),
    Rule(4, "reproduced", "no part of this (?:publication|book|work) may be reproduced", "reserved", 0.7),
]


def version_pattern(version: str) -> str:
    major, minor = version.split(".")
    return f"(?: version| v)? v?{major}" + (f"(?: {minor})?(?! [0-9])" if minor == "0" else f" {minor}(?! [0-9])")


def signatures() -> list[Rule]:
    """All rules: each family's names as tag, address, notice and mention, with each version and without."""
    rules = list(NOTICES)
    for family in FAMILIES:
        for version in ("", *family.versions):
            label = f"{family.label}-{version}" if version else family.label
            tail, bonus = (version_pattern(version), 0.05) if version else ("", 0.0)
            rules.append(Rule(2 if version else 3, family.keyword, UNDER + family.names + tail, label, 0.9 + bonus))
            rules.append(Rule(3 if version else 5, family.keyword, family.names + tail, label, 0.6 + 4 * bonus))
            if family.address:
                rules.append(Rule(2 if version else 4, family.keyword if family.keyword in family.address else "org", family.address + tail.replace("(?: version| v)?", "(?: v)?"), label, 0.85 + bonus))
        first = family.label.replace("-", " ")
        for version in ("", *family.versions):
            rules.append(Rule(0 if version else 1, "spdx", "spdx licen[cs]e identifier " + first + (version_pattern(version) + "(?: only| or later)?" if version else ""), f"{family.label}-{version}" if version else family.label, 1.0))
    unique = {(r.regex, r.label): r for r in reversed(rules)}
    return sorted(unique.values(), key=lambda r: (r.priority, r.label, r.regex))


PRIORITIES = 6


def literal_rules(rules: list[Rule]) -> Column:
    """The rules as one constant array of (keyword, rules)."""
    groups: dict[str, list[Column]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.keyword, []).append(F.struct(
            F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"),
            F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"),
        ))
    return F.array(*[F.struct(F.lit(f" {word} ").alias("keyword"), F.array(*held).alias("rules")) for word, held in groups.items()])


def rules_for(text: Column, rules: list[Rule]) -> Column:
    """The rules whose keyword a normalised text holds; nothing is tried on texts that did not pass the gate."""
    groups = F.filter(literal_rules(rules), lambda g: text.contains(g["keyword"]))
    return F.when(text.isNotNull(), F.flatten(F.transform(groups, lambda g: g["rules"])))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def any_of(words: list[str]) -> str:
    """An expression for any of the words that shares their common beginnings, so that few branches are tried at each place."""
    ends, by_first = "" in words, {}
    for word in words:
        if word:
            by_first.setdefault(word[0], []).append(word[1:])
    branches = [first + any_of(rest) for first, rest in sorted(by_first.items())]
    if not branches:
        return ""
    return branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})" + "?" * ends


def gate(rules: list[Rule]) -> str:
    """One expression for texts that hold any rule's keyword, or any base phrase, as whole words."""
    words = {r.keyword for r in rules} | {p.split()[0] for p in BASE}
    # These two are no signs of a license by themselves.
    after = {"cc": "by", "all": "rights"}
    pairs = [rf"{w}[{SEPARATORS}]+{then}" for w, then in after.items()]
    return rf"(?i)(?<![^{SEPARATORS}])(?:{any_of(sorted(words - set(after)))}|{'|'.join(pairs)})(?![^{SEPARATORS}])"


def normalised(text: Column) -> Column:
    """The text's words between single spaces, with a space at either end."""
    words = F.regexp_replace(F.translate(text, UPPER, LOWER), f"[{SEPARATORS}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: word count, base phrases, ``labels``, ``score`` and the kept ``detections``
    (label, first word, end word, priority), ordered."""
    rules = signatures() if rules is None else rules
    text = blank(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        F.size(F.array_remove(F.split(text, f"[{SEPARATORS}]+", -1), "")).cast("long").alias("n_words"),
        F.when(text.rlike(gate(rules)), normalised(text)).alias("_s"),
    )
    for i, phrase in enumerate(BASE):
        rows = rows.withColumn(f"_p{i}", F.when(F.col("_s").contains(f" {phrase} "), F.split("_s", f"(?<= ){phrase}(?= )", -1)))
    size = {p: len(p.split()) for p in BASE}
    found = {p: F.col(f"_p{i}") for i, p in enumerate(BASE)}
    base = [
        sum((F.coalesce(F.size(c) - 1, F.lit(0)) for c in found.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[(spaces(c[0]) - 1).cast("long") for c in found.values()]).alias("first_word"),
        F.greatest(*[(F.col("n_words") - spaces(F.element_at(c, -1)) + 1 - size[p]).cast("long") for p, c in found.items()]).alias("last_word"),
        F.filter(F.array(*[F.when(c.isNotNull(), F.lit(BASE[p])) for p, c in found.items()]), lambda x: x.isNotNull()).alias("_base"),
    ]
    tried = rows.select(
        "_row", "_id", "n_words", *base, "_s",
        F.explode_outer(rules_for(F.col("_s"), rules)).alias("r"),
    )
    kept = ["_row", "_id", "n_words", "n_base", "first_word", "last_word", "_base"]
    # An expression that does not match leaves one row with nulls, so that no document is lost on the way.
    parts = tried.select(
        *kept, "r.rule", "r.priority", "r.label", "r.weight",
        F.regexp_extract_all("_s", F.col("r.regex"), F.lit(0)).alias("matches"), F.split("_s", F.col("r.regex"), -1).alias("pieces"),
    )
    matches = parts.select(
        *kept, "rule", "priority", "label", "weight",
        F.explode_outer(F.transform("matches", lambda m, i: F.struct(
            i.alias("at"), (spaces(m) + 1).alias("words"), spaces(F.get("pieces", i)).alias("gap")))).alias("m"),
    ).select(*kept, "rule", "priority", "label", "weight", "m.*")
    one = Window.partitionBy("_row", "rule").orderBy("at")
    spans = matches.withColumn(
        "start", F.sum("gap").over(one) + F.sum(F.col("words") - 1).over(one) - (F.col("words") - 1) - 1
    ).withColumn("end", F.col("start") + F.col("words"))
    earlier = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    # Containment: among the spans that start no later, one of no worse priority reaches as far.
    hidden = F.lit(False)
    for p in range(PRIORITIES):
        spans = spans.withColumn(f"_reach{p}", F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier))
        hidden = F.when(F.col("priority") == p, F.coalesce(F.col(f"_reach{p}") >= F.col("end"), F.lit(False))).otherwise(hidden)
    seen = F.when(F.col("start").isNotNull() & ~hidden, F.struct("start", "end", "priority", "label", "weight"))
    return (
        spans.groupBy("_row").agg(
            *(F.first(c).alias(c) for c in kept[1:]), F.array_sort(F.collect_list(seen)).alias("detections"),
        )
        .select(
            F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
            F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.col("detections.label")))), ",").alias("labels"),
            F.coalesce(F.array_max("detections.weight"), F.lit(0.0)).alias("score"), "detections",
        )
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all rules."""
    rows = scan(read_table(spark, sf_dir, "documents"))
    return rows.withColumn("n_detections", F.size("detections").cast("long")).drop("detections")


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
