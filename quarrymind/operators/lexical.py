"""Inverted index, BM25 search and substring search over document tables."""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrymind.functions import text as tx
from quarrymind.functions.rows import unfold
from quarrymind.operators.ranking import top_k
from quarrymind.session import cut_lineage, scratch_path, small_side

K1 = 1.2
B = 0.75


BUCKETS = 64
#: Shares that the documents of a bucket are dealt into, at least; more documents have more shares, so that one stays as large.
SPREAD = 4
SHARE_DOCS = 1 << 14
#: Classes of like length that documents are put into.
LENGTHS = 64
#: Documents of a block, about; a search skips blocks whose largest impacts cannot reach its threshold.
BLOCK_DOCS = 256
#: Scores of equal hits that are summed in another order differ by less.
SLACK = 1e-6
#: A query's threshold comes from its rarest terms, until they have so many postings for each hit asked for, and of so many documents.
FIRST_POSTINGS = 32
FIRST_HITS = 3
#: From so many postings of all queries' terms on a search is pruned; below, scoring them all takes less time than the jobs that pruning starts.
PRUNE_FROM = 100_000_000
#: Pairs of a query and a posting that a task scores, about.
TASK_PAIRS = 1 << 20


class LexicalIndex(NamedTuple):
    """``postings(addition, bucket, block, term, doc_id, tf, dl)``, ``peaks(addition, bucket, term, block, n, impact, at)`` with the number of postings
    and the largest impact of each term in each block, at the mean document length ``at``, and ``stats(addition, n_docs, words)`` with one row per addition.

    Stored postings lie in one folder per addition and bucket of terms, so a search reads the buckets of its terms only.
    """

    postings: DataFrame
    peaks: DataFrame
    stats: DataFrame

    @property
    def terms(self) -> DataFrame:
        """``(term, df)`` of all terms."""
        return self.peaks.groupBy("term").agg(F.sum("n").alias("df"))

    @property
    def totals(self) -> DataFrame:
        """One row ``(n_docs, avgdl)``."""
        return self.stats.agg(F.sum("n_docs").alias("n_docs"), (F.sum("words") / F.sum("n_docs")).alias("avgdl"))


def terms_of(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"(?U)\W+"), lambda w: w != "")


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(docs: DataFrame, key: str, col: str, addition: str) -> DataFrame:
    """Terms counted by document. Rows of a bucket and a share of the documents meet in one task, which is also how they are stored."""
    # Documents of like length share a block, so that the largest impact in a block says something of all its documents.
    length = F.coalesce(F.least(F.floor(F.log2(F.length(col).cast("double")) * 2), F.lit(LENGTHS - 1)), F.lit(0)).cast("int")
    sizes = {r["length"]: r["count"] for r in docs.groupBy(length.alias("length")).count().collect()}  # one row per class
    blocks = F.get(F.array(*[F.lit(-(-sizes.get(k, 0) // BLOCK_DOCS) or 1) for k in range(LENGTHS)]), F.col("length"))
    block = F.lit(zlib.crc32(addition.encode()) << 31) + F.col("length").cast("long") * (1 << 25) + F.pmod(F.xxhash64("doc_id"), blocks)
    shares = max(SPREAD, -(-sum(sizes.values()) // SHARE_DOCS))
    worded = docs.select(F.col(key).alias("doc_id"), length.alias("length"), terms_of(col).alias("terms")).select(
        "doc_id", "length", F.size("terms").alias("dl"), "terms"
    )
    rows = unfold(worded, ["doc_id", "length", "dl"], "terms", "term").select(
        _bucket("term").alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(shares)).alias("share"), "term", "doc_id", "length", "dl"
    )
    counted = rows.repartition("bucket", "share").groupBy("bucket", "share", "term", "doc_id", "length", "dl").agg(F.count("*").cast("int").alias("tf"))
    return counted.select("bucket", block.alias("block"), "term", "doc_id", "tf", "dl")


def _impact(tf: str, dl: str, avgdl: Column) -> Column:
    """What a posting adds to a score, per unit of its term's weight; grows with the count and falls with the document's length."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / avgdl))


def _peaks(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """The largest impact of each term in each block, at the mean length ``at`` of the addition."""
    at = stats.select((F.col("words") / F.col("n_docs"))).scalar()
    most = F.max(_impact("tf", "dl", at)).alias("impact")
    return postings.groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), most).withColumn("at", at)


def _stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents, from the table, and words, from the postings."""
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0).cast("long"))).scalar()
    return docs.agg(F.count("*").alias("n_docs")).select("n_docs", words.alias("words"))


def build_index(docs: DataFrame, key: str = "doc_id", col: str = "text", saved: bool = True, folder: str | None = None) -> LexicalIndex:
    """An index of a document table; with ``saved`` it is stored in ``folder`` (a new scratch folder without one).

    A stored index is read by later searches, can be opened again with :func:`load_index` and grows by :func:`add_to_index`.
    """
    if not saved:
        postings = _postings(docs, key, col, "")
        stats = _stats(docs, postings)
        return LexicalIndex(postings, _peaks(postings, stats), stats)
    folder = folder or scratch_path(docs.sparkSession, "index")
    add_to_index(docs, folder, key, col, "built")
    return load_index(docs.sparkSession, folder)


def addition_name(docs: DataFrame, key: str, col: str) -> str:
    """A name that the same documents have again, in whatever order they come."""
    row = F.xxhash64(F.col(key), F.col(col))
    sign = docs.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))), F.lit(0))).first()
    return hashlib.sha256(repr(tuple(sign)).encode()).hexdigest()[:16]


def add_to_index(docs: DataFrame, folder: str, key: str = "doc_id", col: str = "text", addition: str | None = None) -> None:
    """Store the postings of documents that the index does not hold yet.

    An addition has a folder of its own by its name (by default one made from its documents), so an addition that is repeated, or that failed
    half way and is done again, changes nothing. Its statistics are written last, and readers take only additions that have them. Postings
    are dealt by bucket and a few shares of the documents, so a frequent term's postings are written by several tasks.
    """
    addition = addition or addition_name(docs, key, col)
    part = f"addition={addition}"
    rows = _postings(docs, key, col, addition).sortWithinPartitions("bucket", "term", "block")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/{part}")
    kind = docs.schema[key].dataType.simpleString()
    written = docs.sparkSession.read.schema(f"block long, term string, doc_id {kind}, tf int, dl int, bucket int").parquet(f"{folder}/postings/{part}")
    stats = cut_lineage(_stats(docs, written).withColumn("kind", F.lit(kind)), "stats")
    _peaks(written, stats).sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{folder}/peaks/{part}")
    stats.write.mode("overwrite").parquet(f"{folder}/stats/{part}")


def load_index(spark: SparkSession, folder: str) -> LexicalIndex:
    stats = spark.read.schema("n_docs long, words long, kind string, addition string").parquet(f"{folder}/stats")
    named = stats.select("addition", "kind").collect()  # one row per addition
    whole = F.col("addition").isin([r["addition"] for r in named])
    postings = spark.read.schema(f"block long, term string, doc_id {named[0]['kind']}, tf int, dl int, addition string, bucket int").parquet(f"{folder}/postings")
    peaks = spark.read.schema("bucket int, term string, block long, n long, impact double, at double, addition string").parquet(f"{folder}/peaks")
    return LexicalIndex(postings.where(whole), peaks.where(whole), stats.select("addition", "n_docs", "words"))


class Search(NamedTuple):
    """Parts of a search: ``read`` the postings of the buckets asked for, ``peaks`` those of the terms, ``wanted(query_id, n_terms, term, bucket, df,
    idf)``, which is written, and the mean document length."""

    read: DataFrame
    peaks: DataFrame
    wanted: DataFrame
    avgdl: Column


def _prepare(index: LexicalIndex, queries: DataFrame, query_id: str, col: str) -> Search:
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(terms_of(col)).alias("terms"))
    wanted = unfold(asked, ["query_id", F.size("terms").alias("n_terms")], "terms", "term").withColumn("bucket", _bucket("term"))
    stats = index.totals.first()
    n_docs, avgdl = stats["n_docs"], F.lit(stats["avgdl"])
    terms = small_side(wanted.select("term", "bucket").distinct())
    # Their buckets, never more than there are, are all that is read of a stored index.
    asked_for = F.col("bucket").isin([r["bucket"] for r in terms.select("bucket").distinct().collect()])
    peaks = index.peaks.where(asked_for).join(terms, ["bucket", "term"])
    df = peaks.groupBy("term").agg(F.sum("n").alias("df"))
    wanted = small_side(wanted.join(df, "term").withColumn("idf", F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    return Search(index.postings.where(asked_for), peaks, wanted, avgdl)


def _bounds(search: Search) -> DataFrame:
    """(query_id, term, bucket, block, n, most): a term's postings in a block and the most that they can add. At another mean length than its addition's an impact is larger by no
    more than the factor that the mean has grown by. Written."""
    impact = F.col("impact") * F.greatest(F.lit(1.0), search.avgdl / F.col("at"))
    bounds = search.peaks.join(search.wanted, ["bucket", "term"]).select(
        "query_id", "term", "bucket", "block", "n", (F.col("idf") * impact).alias("most")
    )
    return cut_lineage(bounds, "bounds")


def _dealt(search: Search, terms: DataFrame, pairs: int | None, *keys: str) -> DataFrame:
    """Postings of the ``terms``, dealt by ``keys`` into tasks of like work. As they are stored, a file of a frequent term is small but meets
    every query that has the term, so tasks that are as many as the files' bytes ask for would be few and uneven."""
    return search.read.join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").repartition(-(-(pairs or 0) // TASK_PAIRS) or 1, *keys)


def _scores(search: Search, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): sums over all postings of the stored ``terms`` of the queries. What is dealt by document is summed in place."""
    found = _dealt(search, terms, terms.agg(F.sum("df")).first()[0], "doc_id").join(terms, ["bucket", "term"])
    return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * _impact("tf", "dl", search.avgdl)).alias("score"))


def _lifted(search: Search, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the postings of single documents: ``terms`` of the queries in their ``hits(query_id, doc_id)``."""
    lookups = hits.select("query_id", "doc_id").join(terms.select("query_id", "bucket", "term", "idf"), "query_id")
    found = search.read.join(small_side(lookups), ["bucket", "term", "doc_id"])
    return found.select("query_id", "doc_id", (F.col("idf") * _impact("tf", "dl", search.avgdl)).alias("score"))


def _thresholds(search: Search, top: int) -> DataFrame:
    """(query_id, least): what a query's last hit scores at least, 0 if too few documents are known.

    The postings of its rarest terms name documents, the best of these are scored in full, and the last hit can be no worse than theirs.
    """
    rarer = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = search.wanted.withColumn("_before", F.coalesce(F.sum("df").over(rarer), F.lit(0))).where(F.col("_before") < FIRST_POSTINGS * top)
    return _last_score(search, _scores(search, small_side(rare.drop("_before"))), search.wanted, top)


def _last_score(search: Search, scored: DataFrame, rest: DataFrame, top: int) -> DataFrame:
    """(query_id, least): the score of the last of ``top`` hits among the documents that ``scored`` puts first, after ``rest`` of the terms are added."""
    best = cut_lineage(top_k(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], FIRST_HITS * top).select("query_id", "doc_id", "score"), "best")
    known = _lifted(search, best, rest) if rest is search.wanted else best.unionByName(_lifted(search, best, rest))
    last = top_k(known.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), ["query_id"], [F.col("score").desc()], top).where(F.col("rank") == top)
    return small_side(search.wanted.select("query_id").distinct().join(last, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("least")))


def _pruned(search: Search, top: int) -> tuple[DataFrame, DataFrame]:
    """What has to be scored: ``needed(query_id, bucket, term, block, n, idf, least, spare)``, the ``n`` postings that a hit must have one of, in the blocks that
    can reach the threshold, with the most that the query's other terms add in the block; and those others."""
    bounds, least = _bounds(search), _thresholds(search, top)
    largest = bounds.groupBy("query_id", "term").agg(F.max("most").alias("most"))
    ranked = search.wanted.join(largest, ["query_id", "term"]).join(least, "query_id")
    rising = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    # The weakest terms, as long as all of them together stay below the threshold: no hit has these alone.
    terms = cut_lineage(ranked.withColumn("other", F.sum("most").over(rising) < F.col("least") - SLACK).drop("most"), "terms")
    placed = bounds.join(terms.select("query_id", "term", "idf", "least", "other"), ["query_id", "term"])
    blocks = placed.groupBy("query_id", "block").agg(F.sum("most").alias("most"), F.sum(F.when(F.col("other"), F.col("most")).otherwise(0.0)).alias("spare"), F.first("least").alias("least"))
    alive = blocks.where(F.col("most") >= F.col("least") - SLACK).select("query_id", "block", "spare")
    needed = placed.where("not other").drop("most", "other").join(alive, ["query_id", "block"])
    return small_side(needed), terms.where("other").drop("other", "least")


def _near(search: Search, top: int) -> DataFrame:
    """(query_id, doc_id, score) of the documents that can be among the ``top`` hits."""
    needed, others = _pruned(search, top)
    placed = ["bucket", "term", "block"]
    found = _dealt(search, needed, needed.agg(F.sum("n")).first()[0], *placed).join(needed, placed)
    first = cut_lineage(found.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("idf") * _impact("tf", "dl", search.avgdl)).alias("score"), F.first("spare").alias("spare")
    ), "first")
    # What is first now gives a threshold that is close to the last hit's score.
    near = first.join(_last_score(search, first, others, top), "query_id").where(F.col("score") + F.col("spare") >= F.col("least") - SLACK)
    near = cut_lineage(near.select("query_id", "doc_id", "score"), "near")
    return near.unionByName(_lifted(search, near, others)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _all_terms(search: Search) -> DataFrame:
    """(query_id, doc_id, score) of the documents that hold every term of a query. Terms that no document has are not in ``wanted``, so such a query has none."""
    whole = search.wanted.join(search.wanted.groupBy("query_id").agg(F.count("*").alias("known")), "query_id").where("known = n_terms").drop("known")
    ranked = cut_lineage(whole.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))), "by-rarity")
    first = search.read.join(small_side(ranked.where("place = 1")), ["bucket", "term"])
    first = cut_lineage(first.select("query_id", "doc_id", "n_terms", (F.col("idf") * _impact("tf", "dl", search.avgdl)).alias("score")), "rarest")
    rest = _lifted(search, first.where("n_terms > 1"), ranked.where("place > 1"))
    found = first.unionByName(rest, allowMissingColumns=True).groupBy("query_id", "doc_id").agg(
        F.sum("score").alias("score"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms")
    )
    return found.where("matched = n_terms").select("query_id", "doc_id", "score")


def bm25_search(
    index: LexicalIndex, queries: DataFrame, top: int = 10, min_score: float = 0.0, match: str = "any",
    query_id: str = "query_id", col: str = "text", prune: bool | None = None,
) -> DataFrame:
    """Okapi BM25 over a table of queries: ``(query_id, doc_id, score, rank)``.

    Documents match with any query term, or with all of them for ``match='all'``. With ``prune`` (and ``match='any'``) not every posting is scored: the
    rarest terms give each query a threshold that its last hit reaches for sure; blocks whose largest impacts stay below it are left out, and
    frequent terms that cannot reach it together are looked up only for documents that the other terms bring near it. The hits are the
    same; it takes about ten more jobs, which pay where the postings of frequent terms are many times larger than a job's start. Without a choice
    (None) searches of ``PRUNE_FROM`` postings and more are pruned. With ``match='all'`` a query's rarest term names the documents, and the
    others are looked up for these only.
    """
    search = _prepare(index, queries, query_id, col)
    if match == "all":
        found = _all_terms(search)
    else:
        if prune is None:
            prune = search.wanted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] >= PRUNE_FROM
        found = _near(search, top) if prune else _scores(search, search.wanted)
    ranked = top_k(found.withColumn("score", F.round("score", 9)), ["query_id"], [F.col("score").desc(), F.col("doc_id")], top)
    return ranked.where(F.col("score") >= min_score).select("query_id", "doc_id", "score", "rank")


def search_report(index: LexicalIndex, queries: DataFrame, top: int = 10, query_id: str = "query_id", col: str = "text") -> DataFrame:
    """(query_id, blocks, skipped_blocks, postings, scored_postings): what pruning saves each query, without its look-ups for single documents."""
    search = _prepare(index, queries, query_id, col)
    needed, _ = _pruned(search, top)
    peaks = search.peaks.join(search.wanted, ["bucket", "term"]).groupBy("query_id").agg(F.count_distinct("block").alias("blocks"))
    kept = needed.groupBy("query_id").agg(F.count_distinct("block").alias("kept"))
    size = search.wanted.groupBy("query_id").agg(F.sum("df").alias("postings"))
    scored = search.read.join(needed, ["bucket", "term", "block"]).groupBy("query_id").agg(F.count("*").alias("scored"))
    whole = size.join(peaks, "query_id").join(kept, "query_id", "left").join(scored, "query_id", "left")
    return whole.select(
        "query_id", "blocks", (F.col("blocks") - F.coalesce("kept", F.lit(0))).alias("skipped_blocks"), "postings", F.coalesce("scored", F.lit(0)).alias("scored_postings")
    )


def search_multi_field(
    indexes: dict[str, LexicalIndex], queries: DataFrame, weights: dict[str, float] | None = None, top: int = 10,
    query_id: str = "query_id", col: str = "text",
) -> DataFrame:
    """Search each field for twice ``top`` hits and add up the weighted scores per document."""
    weights = weights or {"content": 1.0, "title": 1.5}
    found = None
    for field, index in indexes.items():
        hits = bm25_search(index, queries, top * 2, query_id=query_id, col=col).select(
            "query_id", "doc_id", (F.col("score") * weights.get(field, 1.0)).alias("score")
        )
        found = hits if found is None else found.unionByName(hits)
    summed = found.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_k(summed, ["query_id"], [F.col("score").desc(), F.col("doc_id")], top)


def _grams(c: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def substring_pairs(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs ``(string, pattern)`` where the string contains the pattern.

    Inputs are distinct ``string`` and ``pattern`` columns. Each pattern is looked up by
    the rarest of its three-character pieces (or itself when shorter), an equi-join that
    replaces comparing every string with every pattern.
    """
    piece = F.when(F.length("pattern") <= 3, F.array("pattern")).otherwise(_grams(F.col("pattern"), 3))
    pieces = unfold(patterns.where(F.length("pattern") > 0), ["pattern"], F.array_distinct(piece), "gram")
    grams = F.array_distinct(F.concat(*[_grams(F.col("string"), n) for n in (1, 2, 3)]))
    string_grams = cut_lineage(
        unfold(strings, ["string"], grams, "gram").join(small_side(pieces.select("gram").distinct()), "gram", "left_semi"), "grams"
    )
    sizes = string_grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        pieces.join(sizes, "gram", "left")
        .groupBy("pattern")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    return (
        string_grams.join(rarest, "gram")
        .where(F.contains("string", "pattern"))
        .select("string", "pattern")
    )


def query_keywords(queries: DataFrame, query_id: str = "query_id", col: str = "text", first: int = 5, keywords: int = 10) -> DataFrame:
    """Up to ``keywords`` keywords per query, or its ``first`` words when it has none."""
    return queries.select(F.col(query_id).alias("query_id"), tx.keywords(col, keywords).alias("kw"), tx.words(F.lower(F.col(col))).alias("w")).select(
        "query_id", F.when(F.size("kw") > 0, F.col("kw")).otherwise(F.slice("w", 1, first)).alias("keywords")
    )


def keyword_fallback(
    docs: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = 0.0, key: str = "doc_id",
    col: str = "text", query_id: str = "query_id", query_col: str = "text", direct: int = 5, keywords: int = 10,
) -> DataFrame:
    """Documents containing any of a query's first ``direct`` keywords, scored by capped counts of all of them.

    A keyword has no white space, so each of its occurrences lies inside one space-free
    token. Substring search therefore runs over the distinct tokens, and counts per
    document come from (token, document) pairs.
    """
    kw = unfold(
        query_keywords(queries, query_id, query_col, direct, keywords), ["query_id", F.size("keywords").alias("n_kw")], "keywords", "pattern", "pos"
    )
    counted = unfold(docs, [F.col(key).alias("doc_id")], tx.count_runs(tx.words(F.lower(F.col(col)))), "r")
    tokens = cut_lineage(
        counted.select("doc_id", F.col("r.word").alias("string"), F.col("r.n").alias("tf")), "tokens"
    )
    pairs = substring_pairs(tokens.select("string").distinct(), kw.select("pattern").distinct())
    pairs = cut_lineage(pairs, "pairs")  # its real size decides how the tokens meet it
    times = ((F.length("string") - F.length(F.replace(F.col("string"), F.col("pattern"), F.lit("")))) / F.length("pattern")).cast("int")
    counts = (
        tokens.join(pairs.withColumn("times", times), "string")
        .groupBy("doc_id", "pattern")
        .agg(F.least(F.sum(F.col("tf") * F.col("times")), F.lit(3)).alias("n"))
    )
    scored = (
        counts.join(kw, "pattern")
        .groupBy("query_id", "doc_id")
        .agg(
            F.round(F.sum("n") / (F.first("n_kw") * 3), 9).alias("score"),
            F.max((F.col("pos") < direct).cast("int")).alias("direct"),
        )
        .where((F.col("direct") == 1) & (F.col("score") >= min_score))
    )
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], limit).select(
        "query_id", "doc_id", "score", "rank"
    )


def find_by_substring(
    texts: DataFrame, queries: DataFrame, key: str, cols: list[str], limit: int = 5, query_id: str = "query_id",
    query_col: str = "text",
) -> DataFrame:
    """Rows whose columns contain the query text, ignoring case; the first ``limit`` by key per query."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.lower(query_col).alias("pattern")).where(F.length("pattern") > 0)
    rows = unfold(
        texts, [F.col(key).alias("_key")], F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in cols]))), "string"
    )
    pairs = substring_pairs(rows.select("string").distinct(), wanted.select("pattern").distinct())
    found = (
        wanted.join(pairs, "pattern").join(rows, "string").select("query_id", F.col("_key").alias(key)).distinct()
    )
    return top_k(found, ["query_id"], [F.col(key)], limit)
