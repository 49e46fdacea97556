"""Steps over whole texts: cheap tests come before patterns and Python, and the rows stay what they were."""

import re
import unicodedata

from pyspark.sql import functions as F

from quarrymind.functions import text as tx
from quarrymind.operators import documents as dm

ODD = [
    None, "", " ", "  x　\r\n", "# Title\nbody", "#\n\nNext line here", "a\nbc\n  exactly\t\n", "\n\n12345\n123456 \n", "x\x85y z ", "[a](b) **c**",
    "**a\n* b", "- one\n+ two ```", "  <HTML><title> T </title>", "a <body", " <!DocType html>", "](", "[x](y) # z", "é́ ﬁ ½ é ñ ß", "ẛ̣", "\n#  \n**b** `x`",
]


def test_texts_are_read_as_by_whole_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")
    line = F.get(F.filter(F.transform(F.split(strip(F.col("t")), "\n"), strip), lambda l: F.length(l) > 5), F.lit(0))
    heading, named = F.regexp_extract("t", r"(?mdU)^#\s+(.+)$", 1), F.regexp_extract("t", r"(?i)<title>([^<]+)</title>", 1)
    marks = [r"(?mdU)^#{1,6}\s", r"\*\*[^*]+\*\*", r"(?d)\[.+\]\(.+\)", r"(?mdU)^[-*+]\s", "```"]
    kind = F.when(F.coalesce(F.length("t"), F.lit(0)) == 0, "unknown").when(F.lower(strip(F.col("t"))).rlike(r"^(<!doctype|<html|<head|<body)"), "html").when(
        sum((F.col("t").rlike(p).cast("int") for p in marks), F.lit(0)) >= 2, "markdown").otherwise("text")
    title = F.when(F.coalesce(F.length("t"), F.lit(0)) == 0, "").otherwise(F.coalesce(
        F.when(F.length(heading) > 0, strip(heading)), F.when(F.length(named) > 0, strip(named)), line, F.lit(tx.NO_TITLE)))
    for row in df.select("t", strip(F.col("t")).alias("a"), tx.strip("t").alias("b"), title.alias("c"), tx.title("t").alias("d"), kind.alias("e"), tx.content_type(F.col("t")).alias("f"),
                         tx.nfkc("t").alias("g")).collect():
        assert (row.a, row.c, row.e) == (row.b, row.d, row.f), row
        assert row.g == (row.t and unicodedata.normalize("NFKC", row.t))


def test_only_texts_that_may_change_travel():
    changeable = re.compile(tx.CHANGEABLE.replace("[^\\x00-\\u0131]]", "]|[^\\x00-\\u0131]"))
    for c in map(chr, range(0x3000)):
        assert changeable.search(c) or unicodedata.normalize("NFKC", "a" + c + "a") == "a" + c + "a"
    assert not changeable.search("El niño está aquí, naïve Größe, façade — no".replace("—", "-"))


def test_words_are_counted_once(spark):
    df = spark.createDataFrame([("# one two\nthree four",), ("",), (None,)], "text string")
    checked = dm.validate_docs(dm.process_documents(df), min_words=6)
    assert [r.error for r in checked.collect()] == ["Contenido muy corto: 5 palabras", "Contenido normalizado vacío", "Contenido normalizado vacío"]
    stated = df.withColumns({"normalized": F.lit("a b"), "title": F.lit("t"), "word_count": F.lit(7)})
    assert dm.validate_docs(stated, min_words=6).where("valid").count() == 3
