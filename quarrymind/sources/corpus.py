"""Landed text files, pages and tenant spaces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

_SPACE_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_]{0,49}")


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Bytes to text: UTF-8 where valid, Latin-1 otherwise."""
    raw = F.col(content)
    return df.withColumn(
        content,
        F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1")),
    )


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: ``(path, content, modified_at)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode_text(files.select("path", "content", F.col("modificationTime").alias("modified_at")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML pages landed as a table ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def for_tenant(df: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """Rows of one tenant; on a table partitioned by tenant only its folders are read."""
    return df.where(F.col(column) == tenant)


def check_space_name(name: str) -> str:
    if not _SPACE_NAME.fullmatch(name):
        raise ValueError(f"not a valid space name: {name}")
    return name


def list_spaces(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def create_space(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA {check_space_name(name)}")


def drop_space(spark: SparkSession, name: str) -> None:
    """Drop a space and its tables; the current one cannot be dropped."""
    if check_space_name(name) == spark.catalog.currentDatabase():
        raise ValueError("cannot drop the current space")
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows to a stored table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
