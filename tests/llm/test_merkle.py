"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrymind.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain_tree(nodes, arity=2):
    """The top of a tree, and for each of its leaves the (before, after) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            first = place - place % arity
            run = nodes[first : first + arity]
            paths[leaf].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        nodes = [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], paths


def plain_manifest(rows, arity=2):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]], arity)
    if not names:
        return out
    root, upper = plain_tree([trees[n][0] for n in names], arity)
    for name, above in zip(names, upper):
        for row, path in zip(groups[name], trees[name][1]):
            path = path + above
            changed = dict(row)
            if row["n_chars"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                changed["n_chars"] += 1
            at = plain_leaf(changed)
            for before, after in path:
                at = sha(before, at, after)
            out.append((row["doc_id"], plain_leaf(row), trees[name][0], root, sha(*(b + a for b, a in path)), at, at == root))
    return sorted(out, key=repr)


def found(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_manifest_of_the_given_documents(spark, docs, tmp_path):
    got = found(spark, docs.repartition(7), tmp_path)
    assert got == plain_manifest([r.asDict() for r in docs.collect()])
    assert {r[6] for r in got} == {True, False}


def test_nulls_ties_repeated_rows_and_clashing_columns(spark, edge, tmp_path):
    extra = edge.withColumns({"tree": F.lit("t"), "digest": F.lit(b"d"), "path": F.lit(1), "n": F.lit(2), "again": F.lit(3), "_row": F.lit(4)})
    extra = extra.withColumn("lang", F.when(F.col("doc_id") == 5, None).when(F.col("doc_id") == 6, "ü").otherwise(F.col("lang")))
    assert found(spark, extra, tmp_path) == plain_manifest([r.asDict() for r in extra.collect()])


def test_empty_table(spark, nothing, tmp_path):
    assert found(spark, nothing, tmp_path) == []


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_any_arity_and_size(spark, arity):
    sizes = [1, 2, 3, 8, 9, 27, 46]
    leaves = [(f"={size:02d}", k, hashlib.sha256(b"%d %d" % (size, k)).digest()) for size in sizes for k in range(size)]
    got = merkle.manifest(spark.createDataFrame(leaves, "tree string, id long, digest binary"), arity).collect()
    groups = {}
    for tree, _, digest in leaves:
        groups.setdefault(tree, []).append(digest.hex())
    names = sorted(groups)
    trees = {n: plain_tree(groups[n], arity) for n in names}
    root, upper = plain_tree([trees[n][0] for n in names], arity)
    assert len(got) == sum(sizes) and {bytes(r.root).hex() for r in got} == {root}
    want = {(n, leaf): path + above for n, above in zip(names, upper) for leaf, path in zip(groups[n], trees[n][1])}
    assert {(r.tree, bytes(r.digest).hex()): [(bytes(s.before).hex(), bytes(s.after).hex()) for s in r.path] for r in got} == want


def test_one_hot_group_is_ranged_over_all_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "=b").otherwise("=a").alias("tree"), "id")
    rows = merkle.numbered(rows, "tree", [F.col("id")], "hot")
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = rows.groupBy("tree", "n").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.count_distinct("place").alias("places"), F.count("*").alias("rows"))
    assert {tuple(r) for r in found.collect()} == {("=a", 19_600, 0, 19_599, 19_600, 19_600), ("=b", 400, 0, 399, 400, 400)}
    assert rows.where("place != id - id div 50 - 1 and tree = '=a' or place != id div 50 and tree = '=b'").count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    rows = merkle.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    cursor = con.execute(merkle.ORACLES["op11_merkle_manifest"])
    assert rows.columns == [d[0] for d in cursor.description]
    assert sorted(map(tuple, rows.collect())) == sorted(cursor.fetchall())
