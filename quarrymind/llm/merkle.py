"""Merkle manifest of a dataset: a digest of every row, a tree over the rows of each group, a tree over the groups' roots, and proofs.

A row's leaf is the SHA-256 of its fields, each written as byte count, ``:`` and value, or as ``-`` if null. Within a group leaves stand in
ascending order; every ``arity`` consecutive nodes of a level make one node above them, the last ones even if they are fewer or
one. What remains alone is the group's subroot (a lone leaf its own), and the subroots in the order of their groups are the leaves of the tree
above them.

Levels are built by sibling-shift self-joins: nodes (tree, place) are joined with the same level on the computed place of their
sibling, ``place XOR 1`` in a binary tree and one join for each slot offset otherwise, and the rows of slot zero then emit
the parents. Each level is written once with its siblings, so a lost executor costs no lower level. Proofs go the way back: a node's path
is its own siblings and then the path of its parent, which a join on the parent's place hands down. Keys are unique places, so no
group is ever held by one task, however many of the rows it has.

Null groups are a group of their own, before all others (groups are ordered by their UTF-8 bytes). Null ids come first. Rows of equal id are
ordered by their leaf; rows that are equal in all fields have equal leaves and take neighbouring places in any order. An empty table
has no trees and gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymind.llm.common import cut_lineage, read_table
from quarrymind.llm.places import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Levels of a proof that are joined in one job before the paths are written.
LEVELS_PER_JOB = 4
TAMPERED_EVERY = 7


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*texts: Column) -> Column:
    """SHA-256 of the texts one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts), 256))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest_of(*map(field, fields))


def tree_name(group: Column) -> Column:
    """Groups as non-null strings of the same order, the null one first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def no_bytes() -> Column:
    return F.lit(b"")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, place, n, digest ...) with ``before`` and ``after``: the digests of the run's other nodes on either side."""
    slot = F.col("place") % arity
    found = nodes
    for shift in range(1, arity):
        place = F.col("place").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("place") - slot + (slot + shift) % arity
        others = nodes.select(F.col("tree"), F.col("place").alias("_at"), F.col("digest").alias(f"_{shift}"))
        found = found.withColumn("_at", place).join(others, ["tree", "_at"], "left").drop("_at")
    shifts = F.array(*(F.col(f"_{shift}") for shift in range(1, arity)))

    def side(taken) -> Column:
        # The node of slot j is the one shifted by j - slot.
        return F.concat(*(
            F.when(taken(F.lit(j), slot), F.coalesce(F.element_at(shifts, F.pmod(F.lit(j) - slot, F.lit(arity)).cast("int")), no_bytes())).otherwise(no_bytes())
            for j in range(arity)
        ))

    sides = [side(lambda j, s: j < s).alias("before"), side(lambda j, s: j > s).alias("after")]
    return found.select(*nodes.columns, *sides)


def climb(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The written levels with their siblings, and (tree, level, digest) of what remains of each tree.

    ``nodes`` (tree, place, n, digest ...) is the lowest level, places gapless from 0 to ``n`` - 1.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        if most <= 1:
            break
        level = cut_lineage(with_siblings(nodes.where("n > 1"), arity), f"level-{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("place") % arity == 0).select(
            "tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest_of(as_hex(F.col("digest")), as_hex(F.col("after"))).alias("digest"),
        )
        most = -(-most // arity)
    return levels, cut_lineage(reduce(DataFrame.union, tops), "subroots")


def hand_down(lowest: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """``lowest`` (tree, place, n, ...) with the columns of ``tops`` (tree, level, path, ...); its siblings go before the path handed down."""
    extra = [c for c in tops.columns if c not in ("tree", "level", "path")]
    keep = [c for c in lowest.columns if c not in ("place", "n")]

    def top(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("_above"), *extra, "path")

    above = None
    for at in reversed(range(len(levels))):
        parents = top(at + 1) if above is None else above.union(top(at + 1))
        rows = levels[at].withColumn("_above", F.expr(f"place div {arity}")).join(parents, ["tree", "_above"])
        path = F.concat(F.array(F.struct("before", "after")), F.col("path")).alias("path")
        if at == 0:
            above = rows.select(*keep, *extra, path)
            break
        above = rows.select("tree", F.col("place").alias("_above"), *extra, path)
        if at % LEVELS_PER_JOB == 0:
            above = cut_lineage(above, f"paths-{at}")
    lone = lowest.where("n = 1").join(top(0).drop("_above"), "tree").select(*keep, *extra, "path")
    return lone if above is None else above.union(lone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda at, s: digest_of(as_hex(s["before"]), as_hex(at), as_hex(s["after"])))


def proof(path: Column) -> Column:
    """SHA-256 of the path's digests as hex text, level by level, left to right."""
    sides = F.transform(path, lambda s: F.concat(as_hex(s["before"]), as_hex(s["after"])))
    return F.sha2(F.array_join(sides, ""), 256)


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` (tree, id, digest, ...) with ``subroot``, ``root`` (32 bytes each) and ``path``, the siblings from the leaf to the root.

    ``leaves`` should be written: it is sorted by (tree, id, digest) and must not have columns of the names used here.
    """
    none = F.array().cast("array<struct<before: binary, after: binary>>")
    lowest = numbered(leaves, "tree", [F.col("id").asc_nulls_first(), F.col("digest")], "leaves")
    levels, subroots = climb(lowest, arity)
    # The subroots are the lowest nodes of one tree more.
    upper = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "digest"), "tree", [F.col("name")], "upper")
    upper_levels, roots = climb(upper, arity)
    tops = roots.select("tree", "level", F.col("digest").alias("root"), none.alias("path"))
    upper = hand_down(upper.withColumnRenamed("level", "height"), [x.withColumnRenamed("level", "height") for x in upper_levels], tops, arity)
    tops = upper.select(F.col("name").alias("tree"), F.col("height").alias("level"), F.col("digest").alias("subroot"), "root", "path")
    return hand_down(lowest, levels, cut_lineage(tops, "tops"), arity)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a leaf that is read again still leads to the root.

    Documents whose id has a crc32 that 7 divides are read with one more in ``n_chars``; a null id or count stays as it is.
    """
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    again = [F.col("n_chars") + 1 if name == "n_chars" else F.col(name) for name in FIELDS]
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), leaf([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(tampered, leaf(again)).alias("again"),
    )
    rows = manifest(cut_lineage(leaves, "digests"))
    rows = rows.withColumn("folded", fold(F.coalesce("again", "digest"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"), as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        proof(F.col("path")).alias("proof_sha256"), as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
#: Trees by recursion over levels, proofs by a recursion over each document's path; crc32 bit by bit (its fixed polynomial is 0xEDB88320).
ORACLES: dict[str, str] = {"op11_merkle_manifest": r"""with recursive numbered as materialized (
  select *, coalesce('=' || lang, '') as tree from documents),
f as (select *, (select list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) as crc from numbered),
leaves as materialized (
  select doc_id, tree, sha256(d || s || l || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') || t) as leaf,
    case when xor(crc, 4294967295) % 7 = 0 and n_chars is not null then sha256(d || s || l || octet_length(encode((n_chars + 1)::varchar)) || ':' || (n_chars + 1) || t) end as again
  from (select *, octet_length(encode(doc_id::varchar)) || ':' || doc_id as d, coalesce(octet_length(encode(source)) || ':' || source, '-') as s,
          coalesce(octet_length(encode(lang)) || ':' || lang, '-') as l, coalesce(octet_length(encode(text)) || ':' || text, '-') as t from f)),
placed as materialized (
  select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as place, count(*) over (partition by tree) as n from leaves),
up as (
  select 0 as level, tree, place, n, leaf as digest from placed
  union all
  select level + 1, tree, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by place)) from up where n > 1 group by level, tree, place // 2),
nodes as materialized (select * from up),
subroots as materialized (
  select tree, digest as subroot, row_number() over (order by encode(tree)) - 1 as place, count(*) over () as n, level as height from nodes where n = 1),
top as (
  select 0 as level, place, n, subroot as digest from subroots
  union all
  select level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by place)) from top where n > 1 group by level, place // 2),
tops as materialized (select * from top),
steps as materialized (
  select p.doc_id, p.tree, u.level, p.place >> u.level as spot, s.digest as sibling
  from placed p join (select distinct tree, level from nodes where n > 1) u using (tree)
  left join nodes s on s.tree = p.tree and s.level = u.level and s.place = xor(p.place >> u.level, 1)
  union all
  select p.doc_id, p.tree, r.height + t.level, r.place >> t.level, s.digest
  from placed p join subroots r using (tree) join (select distinct level from tops where n > 1) t on true
  left join tops s on s.level = t.level and s.place = xor(r.place >> t.level, 1)),
walk as (
  select doc_id, 0 as level, coalesce(again, leaf) as digest from placed
  union all
  select w.doc_id, w.level + 1, sha256(case when spot % 2 = 1 then coalesce(sibling, '') || digest else digest || coalesce(sibling, '') end)
  from walk w join steps s on s.doc_id = w.doc_id and s.level = w.level)
select p.doc_id, leaf, subroot, (select digest from tops where n = 1) as root,
  sha256(coalesce((select string_agg(sibling, '' order by level) from steps s where s.doc_id = p.doc_id), '')) as proof_sha256,
  w.folded_root, w.folded_root = (select digest from tops where n = 1) as verified
from placed p join subroots using (tree) join (select doc_id, arg_max(digest, level) as folded_root from walk group by 1) w using (doc_id)
"""}
