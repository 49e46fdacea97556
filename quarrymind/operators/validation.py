"""Checks of nodes, edges and whole graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fields each node type must have.
REQUIRED = {
    "concept": ["name"],
    "topic": ["name"],
    "chunk": ["content", "source_id"],
    "source": ["title", "content_type"],
    "definition": ["concept_id", "text"],
}

# Node types an edge type may connect, as (from, to).
VALID_PAIRS = {
    "belongs_to": [("concept", "topic"), ("topic", "course"), ("chunk", "source")],
    "contains": [("topic", "concept"), ("course", "topic"), ("source", "chunk")],
    "parent_of": [("chunk", "chunk")],
    "relates_to": [("concept", "concept"), ("topic", "topic")],
    "prerequisite": [("concept", "concept"), ("topic", "topic")],
    "similar_to": [("concept", "concept"), ("chunk", "chunk")],
    "contrasts": [("concept", "concept")],
    "evidenced_by": [("concept", "chunk")],
    "defines": [("definition", "concept")],
    "exemplifies": [("example", "concept")],
}
BIDIRECTIONAL = ("relates_to", "similar_to")


def node_error(columns: list[str]) -> Column:
    """First problem of a node row, or null."""
    error = F.when(~F.col("node_type").isin(*REQUIRED), F.concat(F.lit("unsupported node type: "), F.col("node_type")))
    for kind, fields in REQUIRED.items():
        for field in fields:
            missing = F.lit(True) if field not in columns else F.coalesce(F.length(F.col(field).cast("string")), F.lit(0)) == 0
            error = error.when((F.col("node_type") == kind) & missing, F.lit(f"missing field: {field}"))
    return error


def validate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("error", node_error(nodes.columns)).withColumn("valid", F.col("error").isNull())


def is_bidirectional(edge_type: Column) -> Column:
    return edge_type.isin(*BIDIRECTIONAL)


def edge_error() -> Column:
    """First problem of an edge row that carries ``src_type`` and ``dst_type``."""
    allowed = F.lit(False)
    for kind, pairs in VALID_PAIRS.items():
        for a, b in pairs:
            allowed = allowed | ((F.col("edge_type") == kind) & (F.col("src_type") == a) & (F.col("dst_type") == b))
    return (
        F.when(~F.col("edge_type").isin(*VALID_PAIRS), F.lit("unsupported edge type"))
        .when(~allowed, F.lit("node types not allowed"))
        .when(~F.col("weight").between(0, 10), F.lit("weight out of range"))
        .when(~F.col("confidence").between(0, 1), F.lit("confidence out of range"))
    )


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the end types, the first ``error`` and ``valid``; a missing origin is reported first."""
    # Duplicate node ids must not multiply edges, so types come one per id.
    types = nodes.groupBy("node_id").agg(F.max("node_type").alias("t"))
    src = types.select(F.col("node_id").alias("src"), F.col("t").alias("src_type"))
    dst = types.select(F.col("node_id").alias("dst"), F.col("t").alias("dst_type"))
    error = (
        F.when(F.col("src_type").isNull(), F.lit("origin does not exist"))
        .when(F.col("dst_type").isNull(), F.lit("destination does not exist"))
        .otherwise(edge_error())
    )
    return (
        edges.join(src, "src", "left").join(dst, "dst", "left")
        .withColumn("error", error).withColumn("valid", F.col("error").isNull())
    )


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All problems of a graph: ``(kind, item, error)``."""
    bad_nodes = validate_nodes(nodes).where(~F.col("valid")).select(
        F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("item"), "error"
    )
    repeated = nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("item"), F.lit("duplicate id").alias("error")
    )
    bad_edges = validate_edges(edges, nodes).where(~F.col("valid")).select(
        F.lit("edge").alias("kind"), F.concat_ws("-", "src", "edge_type", "dst").alias("item"), "error"
    )
    return bad_nodes.unionByName(repeated).unionByName(bad_edges)
