"""Shards of nearly equal bytes by Karmarkar-Karp differencing, where rows of equal text stay together.

A row weighs the UTF-8 bytes of its text and one more; rows of equal text are one indivisible group. A partial partition is one load for
each shard; its spread is its largest load less its smallest. Differencing starts from one partial partition for each item (its weight and
zeros), and again and again combines the two of the largest spread, the loads of one in falling and of the other in rising order, until one is
left. Going back through the combinations gives every item its shard. Items that outweigh a shard's fair part stand alone.

Differencing is a sequence, so its input must have a bound: the groups heavier than the whole weight by ``ITEMS`` (of which there are fewer
than ``ITEMS``, whatever the data) are items of their own, and all lighter groups are dealt by the hash of their text into ``ITEMS``
bundles. So no more than ``2 * ITEMS`` numbers reach the driver at any size, large groups meet as many light bundles as can
level them, and the number of items stays far above the number of shards. All else runs on Spark: weights of groups are combined before the shuffle, rows learn
their shard from two broadcast tables of at most ``ITEMS`` rows, and slots are numbered over ranges of (shard, id).

The law is ``bytes``: no shard can be lighter than its heaviest group, and beyond that shards differ by far less than a bundle.
Null and empty texts weigh one byte and are one group. Null ids come first in their shard; rows of equal id are ordered by size and text. Repeated rows
are rows of one group. An empty table has no rows. Fewer groups than shards leave shards empty. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymind.llm.common import blank, cut_lineage, read_table
from quarrymind.llm.places import numbered

SHARDS = 16
ITEMS = 4096


def difference(weights: Sequence[int], ways: int) -> np.ndarray:
    """The shard of each item, by the largest differencing method. Ties take the partial partition that was made first."""
    if not len(weights):
        return np.zeros(0, np.int64)
    # A partial partition holds its loads in falling order; shards of a combination are told by its two parts' shards.
    loads = [np.concatenate([[w], np.zeros(ways - 1, np.int64)]).astype(np.int64) for w in weights]
    parts: list[tuple[int, int, np.ndarray] | None] = [None] * len(loads)
    heap = [(-int(w), n) for n, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = loads[a] + loads[b][::-1]
        order = np.argsort(-joined, kind="stable")
        loads.append(joined[order])
        parts.append((a, b, order))
        loads[a] = loads[b] = None
        heapq.heappush(heap, (int(joined[order[-1]] - joined[order[0]]), len(loads) - 1))
    # Way back: the shard of each load of every partial partition.
    shard: list[np.ndarray | None] = [None] * len(parts)
    shard[-1] = np.arange(ways)
    for n in range(len(parts) - 1, len(weights) - 1, -1):
        a, b, order = parts[n]
        shard[a] = np.empty(ways, np.int64)
        shard[a][order] = shard[n]
        shard[b] = shard[a][::-1]
        shard[n] = None
    return np.array([s[0] for s in shard[: len(weights)]])


def levelled(weights: Sequence[int], ways: int) -> list[int]:
    """The shard of each item. An item of no less than the mean load of the shards that are left has one to itself, since nothing can level it; the
    other items are differenced over the other shards."""
    order = sorted(range(len(weights)), key=lambda i: -weights[i])
    shard, alone, left = [0] * len(weights), 0, sum(weights)
    while alone < min(ways - 1, len(order)) and weights[order[alone]] * (ways - alone) >= left:
        shard[order[alone]] = alone
        left -= weights[order[alone]]
        alone += 1
    rest = order[alone:]
    for i, s in zip(rest, difference([weights[i] for i in rest], ways - alone).tolist()):
        shard[i] = alone + s
    return shard


def bundle(key: Column, items: int) -> Column:
    """The bundle of a group, by the first 48 bits of its digest."""
    return F.pmod(F.conv(F.substring(F.hex(key), 1, 12), 16, 10).cast("long"), F.lit(items))


def assign(rows: DataFrame, shards: int, items: int) -> DataFrame:
    """``rows`` (key, size, ...) with ``shard``; all rows of a key share one. ``rows`` is read three times, so it should be written."""
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    # Python integers: the product may go beyond 64 bits.
    heavy_from = total // items + 1
    heavy = groups.where(F.col("weight") >= heavy_from).collect()
    light = groups.where(F.col("weight") < heavy_from).groupBy(bundle(F.col("key"), items).alias("bundle")).agg(F.sum("weight").alias("weight")).collect()
    heavy.sort(key=lambda r: (-r.weight, bytes(r.key)))
    light.sort(key=lambda r: (-r.weight, r.bundle))
    found = levelled([r.weight for r in [*heavy, *light]], shards)
    spark = rows.sparkSession
    heavy_shards = spark.createDataFrame([(r.key, s) for r, s in zip(heavy, found)], "key binary, _heavy int")
    light_shards = spark.createDataFrame([(r.bundle, s) for r, s in zip(light, found[len(heavy) :])], "_bundle long, _light int")
    known = rows.join(F.broadcast(heavy_shards), "key", "left").withColumn("_bundle", F.when(F.col("_heavy").isNull(), bundle(F.col("key"), items)))
    known = known.join(F.broadcast(light_shards), "_bundle", "left")
    return known.select(*rows.columns, F.coalesce("_heavy", "_light").alias("shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, key, shard, slot) of every row; slots are gapless from 0 in each shard, in the order of ids."""
    text = blank(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key")
    )
    assigned = assign(cut_lineage(rows, "sizes"), shards, ITEMS)
    placed = numbered(assigned, "shard", [F.col("id").asc_nulls_first(), F.col("size"), F.col("key")], "shards")
    return placed.withColumnRenamed("place", "slot").drop("n")


def op13_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; copies of a text share a shard."""
    return shard_rows(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op13_byte_shards": op13_byte_shards}
ORACLES: dict[str, str] = {}
