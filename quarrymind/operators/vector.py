"""Exact and cell-based vector search, thresholds and mean vectors.

Scoring blocks of vectors against blocks of queries is a matrix product, done with numpy
inside tasks; Spark partitions both sides and merges the per-block best lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrymind.functions import vectors as vx
from quarrymind.operators.ranking import top_k
from quarrymind.session import cut_lineage

BLOCK_VALUES = 2_000_000  # numbers in a block, 16 MB
QUERY_ROWS = 512  # queries scored at once, which bounds the score matrix
MAX_CELLS = 1 << 20  # more cells than any index is built with


def _hit_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    """Hits keep the id types of the two sides, text or whole numbers."""
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", vectors.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: unit rows of the vectors of that dimension, and the positions they had. Empty vectors and nulls are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        usable = np.flatnonzero(lengths == dim)
        rows = column.take(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[dim] = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0), usable
    return out


def _first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the ``k`` largest of each row, largest first and ties by place. Only what reaches a row's ``k``-th largest is sorted."""
    n = scores.shape[1]
    if k >= n:
        top = np.argsort(-scores, axis=1, kind="stable")
        return np.repeat(np.arange(len(scores)), n), top.ravel()
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    rows, flat = np.nonzero(scores >= least[:, None])
    order = np.lexsort((flat, -scores[rows, flat], rows))
    rows, flat = rows[order], flat[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], flat[keep]


def _best(qids: np.ndarray, qmat: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, skip_self: bool, schema: pa.Schema) -> pa.RecordBatch:
    """The ``k`` best rows of one block for every query; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, mat = ids[order], mat[order]
    scores = np.round(qmat @ mat.T, 9)
    if skip_self:
        scores[qids[:, None] == ids[None, :]] = -np.inf
    rows, flat = _first(scores, k)
    found = scores[rows, flat]
    keep = found > -np.inf
    columns = (qids[rows][keep], ids[flat][keep], found[keep])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scan_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, skip_self: bool) -> DataFrame:
    """Meet bounded blocks of both sides on ``keys``; a block emits its best hits only. Vectors meet queries of their own dimension."""
    schema = _hit_schema(vectors, queries)
    arrow = to_arrow_schema(schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        asked = _matrices(right["embedding"]) if right.num_rows else {}
        for dim, (mat, at) in (_matrices(left["embedding"]) if left.num_rows and asked else {}).items():
            if dim in asked:
                qmat, used = asked[dim]
                ids, qids = left["doc_id"].to_numpy()[at], right["query_id"].to_numpy()[used]
                for i in range(0, len(qids), QUERY_ROWS):
                    found.append(_best(qids[i : i + QUERY_ROWS], qmat[i : i + QUERY_ROWS], ids, mat, k, skip_self, arrow))
        return pa.Table.from_batches(found, arrow)

    return (
        vectors.select(*keys, "doc_id", "embedding").groupBy(*keys)
        .cogroup(queries.select(*keys, "query_id", "embedding").groupBy(*keys))
        .applyInArrow(score, schema)
    )


def _named(vectors: DataFrame, queries: DataFrame, key: str, col: str, query_id: str, query_col: str) -> tuple[DataFrame, DataFrame]:
    v = vectors.select(F.col(key).alias("doc_id"), F.col(col).alias("embedding"), *[c for c in ("cell",) if c in vectors.columns])
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("embedding"))
    return v.where(F.col("embedding").isNotNull()), q.where(F.col("embedding").isNotNull())


def _blocks(rows: DataFrame, values: int) -> int:
    """Blocks so that each holds about ``values`` numbers."""
    total = rows.agg(F.sum(F.size("embedding"))).first()[0] or 0
    return max(1, -(-total // values))


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0, filters: Column | None = None,
    key: str = "vec_id", col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding",
    skip_self: bool = False, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Exact cosine top-k for a table of queries: ``(query_id, doc_id, score, distance, rank)``.

    Filters apply before ranking; a vector is compared with queries of its own dimension. Both tables are cut into blocks of
    about ``block_values`` numbers that meet block by block, so the vectors are sent once per block of queries. For many
    queries :func:`cell_search` gives the same rows and leaves out what cannot be among them.
    """
    if filters is not None:
        vectors = vectors.where(filters)
    v, q = _named(vectors, queries, key, col, query_id, query_col)
    n_v, n_q = _blocks(v, block_values), _blocks(q, block_values)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v_blocks = v.withColumn("vb", spread("doc_id", n_v)).withColumn("qb", every(n_q))
    q_blocks = q.withColumn("qb", spread("query_id", n_q)).withColumn("vb", every(n_v))
    return _finish(_scan_blocks(v_blocks, q_blocks, ["vb", "qb"], k, skip_self), k, min_score)


def _finish(hits: DataFrame, k: int, min_score: float) -> DataFrame:
    kept = hits.where(F.col("score") >= min_score)
    return top_k(kept, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k).select(
        "query_id", "doc_id", "score", (1 - F.col("score")).alias("distance"), "rank"
    )


def similar_items(
    vectors: DataFrame, items: DataFrame, k: int = 5, min_score: float = 0.5, key: str = "vec_id", col: str = "embedding",
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Nearest other items of each given item; with an ``index`` of :func:`build_ivf` only cells that can hold them are read."""
    asked = items.select(F.col(key).alias("query_id")).distinct()
    queries = vectors.select(F.col(key).alias("query_id"), F.col(col).alias("embedding")).join(asked, "query_id", "left_semi")
    if index is not None:
        return cell_search(*index, queries, k, min_score, key=key, col=col, skip_self=True)
    return vector_search(vectors, queries, k, min_score, key=key, col=col, skip_self=True)


def build_ivf(vectors: DataFrame, n_cells: int = 16, key: str = "vec_id", col: str = "embedding", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Assign unit vectors to k-means cells: ``(vectors with cell, centers(cell, center, radius))``.

    ``radius`` is the largest angle between a cell's center and its vectors. The vectors are written once and read by every
    step of the clustering; null vectors are in no cell and empty ones are left out.
    """
    unit = vectors.where(F.size(col) > 0).withColumn("_unit", vx.l2_normalize(F.col(col)))
    unit = cut_lineage(unit, "unit-vectors").withColumn("_features", array_to_vector("_unit"))
    model = KMeans(k=n_cells, seed=seed, featuresCol="_features", predictionCol="cell", maxIter=10).fit(unit)
    centers = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>"
    )
    cells = cut_lineage(model.transform(unit).drop("_features"), "cells")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), vx.cosine(F.col("_unit"), F.col("center")))))
    radii = cells.join(F.broadcast(centers), "cell").groupBy("cell").agg(F.max(angle).alias("radius"))
    return cells.drop("_unit"), centers.join(radii, "cell")


def _probe(v: DataFrame, q: DataFrame, probes: DataFrame, k: int, block_values: int, skip_self: bool = False) -> DataFrame:
    """Best ``k`` hits of each ``probes(query_id, cell)``; large cells are cut into blocks by their own size."""
    size = F.ceil(F.sum(F.size("embedding")) / block_values).cast("long")
    # One row per cell, so never more rows than cells were asked for.
    sizes = v.groupBy("cell").agg(F.greatest(size, F.lit(1).cast("long")).alias("n_blocks"))
    v_blocks = v.join(F.broadcast(sizes), "cell").withColumn("vb", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")))
    n_q = _blocks(q, block_values)
    v_blocks = v_blocks.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    q_blocks = probes.join(q, "query_id").join(F.broadcast(sizes), "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)))
    q_blocks = q_blocks.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return _scan_blocks(v_blocks, q_blocks, ["cell", "vb", "qb"], k, skip_self)


def ivf_search(
    cells: DataFrame, centers: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 4, min_score: float = 0.0,
    key: str = "vec_id", col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding",
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Score only the ``nprobe`` cells whose centers are nearest to each query. Faster than :func:`cell_search`, not exact."""
    v, q = _named(cells, queries, key, col, query_id, query_col)
    near = _near_cells(centers, q).where(F.col("rank") <= nprobe).select("query_id", "cell")
    return _finish(_probe(v, q, near, k, block_values), k, min_score)


def _near_cells(centers: DataFrame, q: DataFrame) -> DataFrame:
    """``(query_id, cell, rank, best)``: cells by nearness of their centers, and the best score that any vector of the cell can have.

    By the triangle inequality of angles, a vector within ``radius`` of the center is at least ``angle - radius`` from the query.
    """
    found = vector_search(centers, q, MAX_CELLS, -1.0, key="cell", col="center", query_id="query_id", query_col="embedding")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score"))))
    held = found.select("query_id", F.col("doc_id").cast("int").alias("cell"), "rank", angle.alias("angle")).join(
        F.broadcast(centers.select("cell", "radius")), "cell"
    )
    return held.withColumn("best", F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))) + 1e-9)


def cell_search(
    cells: DataFrame, centers: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0, first: int = 1,
    key: str = "vec_id", col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding",
    block_values: int = BLOCK_VALUES, skip_self: bool = False,
) -> DataFrame:
    """The rows of :func:`vector_search`, from the cells that can hold them.

    Each query first meets its ``first`` nearest cells. Its ``k``-th score there is a floor, and of the other cells only those are
    read whose bound reaches it; a skipped cell provably holds no hit.
    """
    v, q = _named(cells, queries, key, col, query_id, query_col)
    near = cut_lineage(_near_cells(centers, q), "near-cells")
    start = cut_lineage(_probe(v, q, near.where(F.col("rank") <= first).select("query_id", "cell"), k, block_values, skip_self), "first-cells")
    floors = top_k(start, ["query_id"], [F.col("score").desc()], k, "_r").groupBy("query_id").agg(
        F.max(F.when(F.col("_r") == k, F.col("score"))).alias("floor")
    )
    more = near.where(F.col("rank") > first).join(floors, "query_id", "left").where(
        F.col("best") >= F.greatest(F.coalesce("floor", F.lit(-1.0)), F.lit(float(min_score)))
    )
    rest = _probe(v, q, more.select("query_id", "cell"), k, block_values, skip_self)
    return _finish(start.unionByName(rest), k, min_score)


def avg_embedding(df: DataFrame, key: str, col: str = "embedding", order: str | None = None) -> DataFrame:
    """Unit-length mean vector per key; one vector stays as it is, and with unequal
    dimensions the first vector (by ``order``) stands for the group."""
    order = order or key
    shape = df.where(F.size(col) > 0).groupBy(key).agg(
        F.count("*").alias("n"), F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi"),
        F.min_by(F.col(col), F.col(order)).alias("first"),
    )
    means = (
        df.select(key, F.posexplode(col).alias("pos", "x"))
        .groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m"))
        .select(key, F.col("m.x").alias("mean"))
    )
    single = F.transform("first", lambda x: x.cast("double"))
    return shape.join(means, key).select(
        key, "n",
        F.when((F.col("n") == 1) | (F.col("lo") != F.col("hi")), single).otherwise(vx.l2_normalize(F.col("mean"))).alias("embedding"),
    )


def filter_threshold(hits: DataFrame, min_score: float = 0.0, max_distance: float = float("inf")) -> DataFrame:
    distance = F.col("distance") if "distance" in hits.columns else 1 - F.col("score")
    return hits.where((F.col("score") >= min_score) & (distance <= max_distance))


def adaptive_threshold(hits: DataFrame, n: int = 5, floor: float = 0.3) -> DataFrame:
    """Per query keep scores at or above the ``n``-th score (not below ``floor``), ties included.

    Queries with at most ``n`` hits keep all of them. The ``n``-th score comes from a pruned
    ranking, and one row per query is joined back.
    """
    best = top_k(hits.select("query_id", "score"), ["query_id"], [F.col("score").desc()], n + 1, "_r")
    limits = best.groupBy("query_id").agg(
        F.max("_r").alias("_found"), F.max(F.when(F.col("_r") == n, F.col("score"))).alias("_nth")
    )
    many = F.col("_found") > n
    return (
        hits.join(limits, "query_id")
        .withColumn("threshold", F.when(many, F.greatest(F.col("_nth"), F.lit(floor))).otherwise(F.lit(floor)))
        .where(~many | (F.col("score") >= F.col("threshold")))
        .drop("_found", "_nth")
    )
