"""Knowledge from stored model responses: concepts, definitions, relations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymind.functions.rows import unfold
from quarrymind.functions.text import bind
from quarrymind.operators.graph import make_edges
from quarrymind.operators.ranking import first_per_key

CONCEPT = "struct<name:string,description:string,aliases:array<string>,difficulty:int,importance:double>"
DEFINITION = "struct<concept:string,definition:string,confidence:double>"
RELATION = "struct<`from`:string,`to`:string,type:string,confidence:double>"
RESOLUTION = "struct<duplicates:array<struct<canonical:string,aliases:array<string>>>>"
RELATION_TYPES = ("prerequisite", "relates_to", "similar_to", "contrasts")


def readable_json(response: Column) -> Column:
    """The JSON inside a response, repaired if need be; null when it cannot be read.

    Takes the text from the first opening to the last closing bracket. A second attempt
    turns single quotes into double ones and drops trailing commas.
    """
    is_json = lambda c: F.try_parse_json(c).isNotNull()
    repair = lambda c: F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")
    return bind(
        F.regexp_extract(response, r"(?s)([\[{].*[\]}])", 1),
        lambda j: F.when(is_json(j), j).otherwise(bind(repair(j), lambda r: F.when(is_json(r), r))),
    )


def parse_responses(extractions: DataFrame, kind: str, item: str) -> DataFrame:
    """Items of the list responses of one kind: ``(source_id, pos, item fields…)``."""
    items = bind(
        readable_json(F.col("response")), lambda j: F.when(F.startswith(j, F.lit("[")), F.from_json(j, f"array<{item}>"))
    )
    return unfold(extractions.where(F.col("kind") == kind), ["source_id"], items, "item", "pos").select("source_id", "pos", "item.*")


def concept_id(source: Column, name: Column) -> Column:
    return F.concat(F.lit("concept:"), F.substring(F.sha2(F.concat_ws("|", source.cast("string"), F.lower(name)), 256), 1, 16))


def concepts_from(extractions: DataFrame) -> DataFrame:
    """Concepts named in the responses, with defaults for what they leave out."""
    found = parse_responses(extractions, "concepts", CONCEPT)
    return found.select(
        "source_id", "pos", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("difficulty", F.lit(1)).alias("difficulty_level"), F.coalesce("importance", F.lit(0.5)).alias("importance_score"),
    )


def alias_map(extractions: DataFrame) -> DataFrame:
    """Lower-cased alias to canonical name per source, from the resolution responses."""
    found = bind(
        readable_json(F.col("response")),
        lambda j: F.when(F.startswith(j, F.lit("{")), F.from_json(j, RESOLUTION)["duplicates"]),
    )
    groups = unfold(extractions.where(F.col("kind") == "resolution"), ["source_id"], found, "d", "g")
    named = groups.select("source_id", "g", F.col("d.canonical").alias("canonical"), F.posexplode("d.aliases").alias("a", "alias"))
    # An alias given twice keeps its last canonical name.
    return named.groupBy("source_id", F.lower("alias").alias("alias")).agg(F.max_by("canonical", F.struct("g", "a")).alias("canonical"))


def resolve_entities(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One concept per canonical name and source, the first listed; a replaced name becomes an alias.

    Sources with a single concept are left alone.
    """
    sizes = concepts.groupBy("source_id").agg(F.count("*").alias("_n"))
    renamed = (
        concepts.join(sizes, "source_id")
        .withColumn("alias", F.lower("name"))
        .join(aliases, ["source_id", "alias"], "left")
        .withColumn("_old", F.col("name"))
        .withColumn("name", F.when(F.col("_n") >= 2, F.coalesce("canonical", "name")).otherwise(F.col("name")))
    )
    kept = first_per_key(
        renamed.withColumn("_key", F.when(F.col("_n") >= 2, F.lower("name")).otherwise(F.col("pos").cast("string"))),
        ["source_id", "_key"], [F.col("pos")],
    )
    replaced = F.lower("_old") != F.lower("name")
    return kept.withColumn(
        "aliases", F.when(replaced, F.concat("aliases", F.array("_old"))).otherwise(F.col("aliases"))
    ).withColumn("concept_id", concept_id(F.col("source_id"), F.col("name"))).select("concept_id", *concepts.columns)


def definitions_from(extractions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Definitions whose concept is known in the same source."""
    found = parse_responses(extractions, "definitions", DEFINITION).withColumn("key", F.lower("concept"))
    known = concepts.where(F.length("name") > 0).select("source_id", F.lower("name").alias("key"), "concept_id")
    return found.join(known, ["source_id", "key"]).select(
        F.concat(F.lit("definition:"), F.substring(F.sha2(F.concat_ws("|", "concept_id", F.col("pos").cast("string")), 256), 1, 16)).alias("definition_id"),
        "source_id", "concept_id", F.coalesce("definition", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
    )


def relationships_from(extractions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges of the four known types whose two ends are concepts of the same source."""
    found = parse_responses(extractions, "relationships", RELATION).where(F.col("type").isin(*RELATION_TYPES))
    known = concepts.where(F.length("name") > 0).select("source_id", F.lower("name").alias("key"), "concept_id")
    ends = (
        found.withColumn("_f", F.lower("from")).withColumn("_t", F.lower("to"))
        .join(known.select("source_id", F.col("key").alias("_f"), F.col("concept_id").alias("src")), ["source_id", "_f"])
        .join(known.select("source_id", F.col("key").alias("_t"), F.col("concept_id").alias("dst")), ["source_id", "_t"])
    )
    return ends.select(
        F.col("type").alias("edge_type"), "src", "dst", F.lit(1.0).alias("weight"),
        F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.lit(0).alias("negative_signals"), "source_id",
    )


def link_evidence(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence edges from a concept to those of its source's chunks that name it."""
    searched = chunks.select("source_id", "chunk_id", F.lower("content").alias("_text"))
    found = concepts.join(searched, "source_id").where(F.contains("_text", F.lower("name")))
    return make_edges(
        found.select(F.col("concept_id").alias("src"), F.col("chunk_id").alias("dst")), "evidenced_by", weight=0.8, confidence=0.7
    )


def transform_report(
    sources: DataFrame, concepts: DataFrame, definitions: DataFrame, relations: DataFrame, extractions: DataFrame
) -> DataFrame:
    """Counts of what was found per source, and the summary cut at 200 characters."""
    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    summary = extractions.where(F.col("kind") == "summary").groupBy("source_id").agg(F.max("response").alias("_s"))
    joined = sources.select("source_id")
    for df, name in ((concepts, "concepts_created"), (definitions, "definitions_created"), (relations, "relationships_created")):
        joined = joined.join(n(df, name), "source_id", "left")
    cut = F.when(F.length("_s") > 200, F.concat(F.substring("_s", 1, 200), F.lit("..."))).otherwise(F.coalesce("_s", F.lit("")))
    return joined.fillna(0).join(summary, "source_id", "left").withColumn("summary", cut).drop("_s")
