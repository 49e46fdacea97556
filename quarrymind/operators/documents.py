"""Document-table jobs: cleaning, titles, types, keywords, sentences, snippets, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymind.functions import text as tx


def normalize_docs(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.normalize(col))


def clean_whitespace(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.clean_whitespace(col))


def strip_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.strip_markdown(col))


def html_to_text(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    return df.withColumn(out, tx.html_to_text(col))


def normalize_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.normalize_markdown(col))


def with_content_type(
    df: DataFrame, content: str = "text", path: str | None = None, url: str | None = None
) -> DataFrame:
    pick = lambda name: F.col(name) if name else None
    return df.withColumn("content_type", tx.content_type(F.col(content), pick(path), pick(url)))


def process_documents(
    df: DataFrame, content: str = "text", path: str | None = None, url: str | None = None
) -> DataFrame:
    """Detect the type, normalise accordingly, and add title and word count.

    The Python-backed NFKC step runs once: type-specific steps happen before or after it.
    """
    typed = with_content_type(df, content, path, url)
    kind = F.col("content_type")
    landed = typed.withColumn(
        "normalized",
        tx.normalize(F.when(kind == "html", tx.html_to_raw_text(content)).otherwise(F.col(content))),
    )
    body = F.col("normalized")
    body = F.when(
        kind == "markdown",
        F.regexp_replace(
            F.regexp_replace(body, r"(?mdU)^(#{1,6})\s*", "$1 "), r"(?mdU)^(\s*)[-*+](\s+)", "$1- "
        ),
    ).otherwise(body)
    detected = tx.title(content)
    if path:
        detected = F.coalesce(tx.title_from_path(path), detected)
    if "title" in df.columns:
        detected = F.coalesce(F.when(F.length("title") > 0, F.col("title")), detected)
    return (
        landed.withColumn("normalized", body)
        .withColumn("title", detected)
        .withColumn("word_count", F.size(tx.words("normalized")))
    )


def with_title(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("title", tx.title(col))


def validate_docs(df: DataFrame, body: str = "normalized", min_words: int = 10) -> DataFrame:
    """Add ``valid`` and the first ``error`` found: empty, too short, or without a title.

    The ``word_count`` that :func:`process_documents` gives for its ``normalized`` text is taken as it is.
    """
    counted = body == "normalized" and "word_count" in df.columns
    n_words = F.col("word_count") if counted else F.size(tx.words(F.coalesce(F.col(body), F.lit(""))))
    error = (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("Contenido normalizado vacío"))
        .when(n_words < min_words, F.concat(F.lit("Contenido muy corto: "), n_words.cast("string"), F.lit(" palabras")))
        .when(F.coalesce(F.length("title"), F.lit(0)) == 0, F.lit("Título no detectado"))
    )
    return df.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def with_token_count(
    df: DataFrame, col: str = "text", tokens: tx.TokenEstimator = tx.estimate_tokens
) -> DataFrame:
    return df.withColumn("token_count", tokens(F.col(col)))


def keywords(df: DataFrame, col: str = "text", n: int = 10) -> DataFrame:
    return df.withColumn("keywords", tx.keywords(col, n))


def truncate(
    df: DataFrame, max_tokens: int, strategy: str = "end", col: str = "text", tokens: tx.TokenEstimator = tx.estimate_tokens
) -> DataFrame:
    return df.withColumn(col, tx.truncate(col, max_tokens, strategy, tokens=tokens))


def truncate_sentences(
    df: DataFrame, max_tokens: int, min_sentences: int = 1, col: str = "text", tokens: tx.TokenEstimator = tx.estimate_tokens
) -> DataFrame:
    return df.withColumn(col, tx.truncate_sentences(col, max_tokens, min_sentences, tokens))


def with_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("sentences", tx.sentences(col))


def split_by(df: DataFrame, separators: list[str], col: str = "text") -> DataFrame:
    return df.withColumn("parts", tx.split_by(col, separators))


def prepare_queries(queries: DataFrame, col: str = "text") -> DataFrame:
    """Drop marks and search metacharacters; queries left empty are removed."""
    return queries.withColumn(col, tx.clean_query(col)).where(F.length(col) > 0)


def snippet(df: DataFrame, n: int = 200, col: str = "text") -> DataFrame:
    return df.withColumn("snippet", tx.snippet(col, n))


def highlights(hits: DataFrame, content: str = "content", query: str = "query", context: int = 100, n: int = 3) -> DataFrame:
    return hits.withColumn("highlights", tx.highlights(content, query, context, n))


def with_content_hash(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("content_hash", tx.content_hash(col))

