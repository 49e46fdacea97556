"""Concept-graph queries over parts, order lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymind.catalog.common import EDGES_SQL, NODES_SQL, edges, nodes, r6, table, with_ctes
from quarrymind.operators import graph, lexical, validation

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def seeds(spark, sf_dir):
    """Benchmark item q starts at part q."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("node_id"))


BOTH_SQL = """both_ways as (
  select src as node_id, dst as neighbor_id, edge_type, weight from edges where src <> dst
  union all select dst, src, edge_type, weight from edges where src <> dst)"""

EXPAND_CTES = (EDGES_SQL, BOTH_SQL, """adj as (
  select node_id, neighbor_id, max(weight) as weight from both_ways
  where weight >= 0.3 and edge_type in ('relates_to', 'prerequisite', 'similar_to') group by 1, 2),
l0 as (select item_id as query_id, item_id as node_id, 1.0::double as score, 0 as depth, [item_id] as path from benchmark),
l1 as (select query_id, neighbor_id as node_id, round(score * weight * 0.8, 9) as score, 1 as depth, list_append(path, neighbor_id) as path
       from l0 join adj using (node_id) where not list_contains(path, neighbor_id)),
l2 as (select query_id, neighbor_id as node_id, round(score * weight * 0.8, 9) as score, 2 as depth, list_append(path, neighbor_id) as path
       from l1 join adj using (node_id) where not list_contains(path, neighbor_id)),
best as (select * from (select * from l0 union all select * from l1 union all select * from l2)
         qualify row_number() over (partition by query_id, node_id order by score desc, depth, path) = 1),
reached as (select *, row_number() over (partition by query_id order by score desc, depth, node_id) as rank
            from best qualify rank <= 30)""")


@query("graph_neighbors", with_ctes(EDGES_SQL, BOTH_SQL) + """
select node_id, neighbor_id, edge_type, weight from both_ways
where weight >= 0.3 and edge_type in ('relates_to', 'prerequisite', 'similar_to')""")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(edges(spark, sf_dir), graph.EXPAND_TYPES, 0.3)


@query("graph_expand", with_ctes(*EXPAND_CTES) + """
select query_id, node_id, round(score, 6) as score, depth, array_to_string(path, '>') as path, rank from reached""")
def graph_expand(spark, sf_dir):
    return graph.expand(seeds(spark, sf_dir), edges(spark, sf_dir)).select(
        "query_id", "node_id", r6("score"), "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "rank"
    )


@query("graph_evidence", with_ctes(*EXPAND_CTES) + """
select query_id, dst as chunk_id, node_id, weight as relevance from reached join edges on src = node_id where edge_type = 'evidenced_by'""")
def graph_evidence(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.evidence(graph.expand(seeds(spark, sf_dir), e), e)


@query("graph_hits", with_ctes(*EXPAND_CTES, NODES_SQL) + """
select query_id, 'chunk' as kind, dst as item_id, md5(text) as content, round(weight, 6) as score
from reached join edges on src = node_id join documents on doc_id = dst where edge_type = 'evidenced_by'
union all select query_id, 'concept', node_id, md5(description), round(score, 6) from reached join nodes using (node_id)
where length(description) > 0""")
def graph_hits(spark, sf_dir):
    e = edges(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    reached = graph.expand(seeds(spark, sf_dir), e)
    return graph.graph_hits(reached, e, nodes(spark, sf_dir), chunks).select(
        "query_id", "kind", "item_id", F.md5("content").alias("content"), r6("score")
    )


@query("graph_limits", with_ctes(*EXPAND_CTES) + """
select query_id, count(*) as n_all, count(*) filter (depth <= 1) as n_shallow, count(*) filter (score >= 0.5) as n_strong
from reached group by 1""")
def graph_limits(spark, sf_dir):
    reached = graph.expand(seeds(spark, sf_dir), edges(spark, sf_dir))
    shallow = graph.limit_depth(reached, 1).groupBy("query_id").agg(F.count("*").alias("n_shallow"))
    strong = graph.prune(reached, 0.5).groupBy("query_id").agg(F.count("*").alias("n_strong"))
    return (
        reached.groupBy("query_id").agg(F.count("*").alias("n_all"))
        .join(shallow, "query_id", "left").join(strong, "query_id", "left").fillna(0)
    )


PATHS_CTES = (EDGES_SQL, BOTH_SQL, """adj as (
  select node_id, neighbor_id, max(weight) as weight, min(edge_type) as edge_type from both_ways where weight >= 0.3 group by 1, 2),
pairs as (select p_partkey as source, p_partkey * 2 as target from part where p_partkey > 0 and p_partkey * 2 in (select p_partkey from part)),
w1 as (select source, target, [source, neighbor_id] as nodes, [edge_type] as types, [1.0::double, weight] as scores
       from pairs join adj on node_id = source),
w2 as (select source, target, list_append(nodes, neighbor_id) as nodes, list_append(types, edge_type) as types,
              list_append(scores, scores[2] * weight) as scores
       from w1 join adj on node_id = nodes[2] where nodes[2] <> target and not list_contains(nodes, neighbor_id)),
w3 as (select source, target, list_append(nodes, neighbor_id) as nodes, list_append(types, edge_type) as types,
              list_append(scores, scores[3] * weight) as scores
       from w2 join adj on node_id = nodes[3] and neighbor_id = target where nodes[3] <> target and not list_contains(nodes, neighbor_id)),
paths as (select * from w1 where nodes[2] = target union all select * from w2 where nodes[3] = target union all select * from w3)""")


@query("graph_paths", with_ctes(*PATHS_CTES) + """
select source, target, array_to_string(nodes, '>') as nodes, array_to_string(types, '>') as types, len(nodes) as length,
       round(list_sum(scores) / len(nodes), 6) as total_score from paths""")
def graph_paths(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    targets = parts.select(F.col("p_partkey").alias("target"))
    pairs = parts.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target")).join(targets, "target", "left_semi")
    found = graph.paths_between(pairs, edges(spark, sf_dir), 3, 0.3)
    return graph.rank_paths(found, "weighted").select(
        "source", "target", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"),
        F.array_join("types", ">").alias("types"), "length", r6("total_score"),
    )


@query("graph_paths_shortest", with_ctes(*PATHS_CTES) + """
select source, target, array_to_string(nodes, '>') as nodes, round(1.0 / (len(nodes) + 1), 6) as total_score
from paths qualify row_number() over (partition by source, target order by len(nodes), nodes) = 1""")
def graph_paths_shortest(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    targets = parts.select(F.col("p_partkey").alias("target"))
    pairs = parts.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target")).join(targets, "target", "left_semi")
    found = graph.paths_between(pairs, edges(spark, sf_dir), 3, 0.3)
    return graph.rank_paths(found, "shortest").where("rank = 1").select(
        "source", "target", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"), r6("total_score")
    )


@query("graph_paths_coverage", with_ctes(*PATHS_CTES) + """
select source, target, count(*) as paths, round(min(1 / 5.0), 6) as lowest, round(max(1 / 5.0), 6) as highest from paths group by 1, 2""")
def graph_paths_coverage(spark, sf_dir):
    """All nodes on the paths are concepts, one of the five types that count."""
    parts = table(spark, sf_dir, "part")
    targets = parts.select(F.col("p_partkey").alias("target"))
    pairs = parts.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target")).join(targets, "target", "left_semi")
    ranked = graph.rank_paths(graph.paths_between(pairs, edges(spark, sf_dir), 3, 0.3), "coverage", nodes(spark, sf_dir))
    return ranked.groupBy("source", "target").agg(
        F.count("*").alias("paths"), F.round(F.min("total_score"), 6).alias("lowest"), F.round(F.max("total_score"), 6).alias("highest")
    )


@query("graph_related", with_ctes(EDGES_SQL, BOTH_SQL, NODES_SQL) + """
select b.node_id, neighbor_id, edge_type, weight, n.name,
       row_number() over (partition by b.node_id order by weight desc, neighbor_id, edge_type) as rank
from (select distinct * from both_ways) b join nodes n on n.node_id = b.neighbor_id
where b.node_id in (select item_id from benchmark) qualify rank <= 10""")
def graph_related(spark, sf_dir):
    return graph.related(seeds(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir)).select(
        "node_id", "neighbor_id", "edge_type", "weight", "name", "rank"
    )


@query("subgraph", with_ctes(*EXPAND_CTES[:-1], EXPAND_CTES[-1].replace(" qualify rank <= 30", "")) + """
select distinct query_id, h.a as src, h.b as dst, 'relates_to' as edge_type from (
  select query_id, unnest(list_transform(range(1, len(path)), lambda i: {'a': path[i], 'b': path[i + 1]})) as h from reached)""")
def subgraph(spark, sf_dir):
    return graph.subgraph(seeds(spark, sf_dir), edges(spark, sf_dir))[1]


@query("find_concepts", """
with q as (select s_suppkey as query_id, lower(split_part(s_name, '#', 2))[8:9] as text from supplier)
select query_id, p_partkey as node_id, row_number() over (partition by query_id order by p_partkey) as rank
from q join part on contains(lower(p_name), text) or contains(lower(p_type), text) qualify rank <= 5
union all
select 100000 + n_nationkey, p_partkey, row_number() over (partition by n_nationkey order by p_partkey) as rank
from (select n_nationkey, (['SMALL', 'ring', 'PROMO', 'steel', 'al'])[n_nationkey % 5 + 1] as text from nation)
join part on contains(lower(p_name), lower(text)) or contains(lower(p_type), lower(text)) qualify rank <= 5""")
def find_concepts(spark, sf_dir):
    by_number = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.substring(F.split_part("s_name", F.lit("#"), F.lit(2)), 8, 2).alias("text")
    )
    by_word = table(spark, sf_dir, "nation").select(
        (F.lit(100000) + F.col("n_nationkey")).cast("long").alias("query_id"),
        F.element_at(F.array(*[F.lit(w) for w in ("SMALL", "ring", "PROMO", "steel", "al")]), F.col("n_nationkey") % 5 + 1).alias("text"),
    )
    return lexical.find_by_substring(
        nodes(spark, sf_dir), by_number.unionByName(by_word), "node_id", ["name", "description"], 5
    ).select("query_id", "node_id", "rank")


# Edge rows with planted faults: some types, weights, confidences and ends are wrong.
FAULTY_SQL = """faulty as (
  select case when src % 11 = 0 then 'mentions' else edge_type end as edge_type,
         case when dst % 13 = 0 then -src - 1 else src end as src, dst,
         case when src % 7 = 0 then weight + 10 else weight end as weight,
         case when dst % 17 = 0 then 1.5 else confidence end as confidence from edges),
all_nodes as (
  select node_id, case when node_id % 19 = 0 then 'chunk' else node_type end as node_type,
         case when node_id % 23 = 0 then '' else name end as name from nodes
  union all select node_id, node_type, name from nodes where node_id % 29 = 0)"""


def faulty(spark, sf_dir):
    src, dst = F.col("src"), F.col("dst")
    e = edges(spark, sf_dir).select(
        F.when(src % 11 == 0, "mentions").otherwise(F.col("edge_type")).alias("edge_type"),
        F.when(dst % 13 == 0, -src - 1).otherwise(src).alias("src"), "dst",
        F.when(src % 7 == 0, F.col("weight") + 10).otherwise(F.col("weight")).alias("weight"),
        F.when(dst % 17 == 0, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
    )
    n = nodes(spark, sf_dir).select("node_id", "node_type", "name")
    mixed = n.select(
        "node_id", F.when(F.col("node_id") % 19 == 0, "chunk").otherwise(F.col("node_type")).alias("node_type"),
        F.when(F.col("node_id") % 23 == 0, "").otherwise(F.col("name")).alias("name"),
    )
    return mixed.unionByName(n.where("node_id % 29 = 0")), e


@query("validate_nodes", with_ctes(NODES_SQL, EDGES_SQL, FAULTY_SQL) + """
select node_id, node_type, case when node_type = 'chunk' then 'missing field: content'
       when coalesce(name, '') = '' then 'missing field: name' end as error from all_nodes""")
def validate_nodes(spark, sf_dir):
    return validation.validate_nodes(faulty(spark, sf_dir)[0]).select("node_id", "node_type", "error")


_EDGE_ERR = """case when s.t is null then 'origin does not exist' when d.t is null then 'destination does not exist'
  when edge_type not in ('relates_to', 'prerequisite', 'evidenced_by') then 'unsupported edge type'
  when not (s.t = 'concept' and d.t = case when edge_type = 'evidenced_by' then 'chunk' else 'concept' end) then 'node types not allowed'
  when weight < 0 or weight > 10 then 'weight out of range' when confidence > 1 then 'confidence out of range' end"""


@query("validate_graph", with_ctes(NODES_SQL, EDGES_SQL, FAULTY_SQL) + f""",
t as (select node_id, max(node_type) as t from all_nodes group by 1)
select 'node' as kind, node_id::varchar as item, case when node_type = 'chunk' then 'missing field: content' else 'missing field: name' end as error
from all_nodes where node_type = 'chunk' or coalesce(name, '') = ''
union all select 'node', node_id::varchar, 'duplicate id' from all_nodes group by node_id having count(*) > 1
union all select 'edge', src || '-' || edge_type || '-' || dst, error from (
  select f.*, {_EDGE_ERR} as error from faulty f left join t s on s.node_id = src left join t d on d.node_id = dst) where error is not null""")
def validate_graph(spark, sf_dir):
    return validation.validate_graph(*faulty(spark, sf_dir))


@query("add_edge_weight", with_ctes(EDGES_SQL) + """
select e.edge_type, e.src, e.dst, round(weight + coalesce(d, 0), 6) as weight from edges e left join (
  select 'prerequisite' as edge_type, l_partkey // 2 as src, l_partkey as dst, sum(l_discount) as d from lineitem group by 2, 3) x
on e.edge_type = x.edge_type and e.src = x.src and e.dst = x.dst""")
def add_edge_weight(spark, sf_dir):
    deltas = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_partkey") / 2).alias("src"), F.lit("prerequisite").alias("edge_type"),
        F.col("l_partkey").alias("dst"), F.col("l_discount").alias("delta"),
    )
    return graph.add_weight(edges(spark, sf_dir), deltas).select("edge_type", "src", "dst", r6("weight"))


@query("make_edges", """
select 'belongs_to' as edge_type, p_partkey as src, p_size::bigint as dst, 1.0::double as weight, 0.8::double as confidence, 0 as negative_signals,
       p_partkey % 10 as order_index from part
union all select 'similar_to', p_partkey, p_partkey + 1, coalesce(case when p_size > 25 then p_retailprice / 1000 end, 0.7), 0.9, 0, null from part""")
def make_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    topics = graph.make_edges(
        part.select("p_partkey", F.col("p_size").cast("long").alias("topic"), (F.col("p_partkey") % 10).alias("order_index")),
        "belongs_to", "p_partkey", "topic",
    )
    alike = graph.make_edges(
        part.select("p_partkey", (F.col("p_partkey") + 1).alias("next"), F.when(F.col("p_size") > 25, F.col("p_retailprice") / 1000).alias("weight")),
        "similar_to", "p_partkey", "next", weight=0.7, confidence=0.9,
    )
    return topics.unionByName(alike, allowMissingColumns=True)


@query("weak_edges", with_ctes(EDGES_SQL) + """
select edge_type, src, dst, weight, negative_signals from edges where weight < 0.3 and negative_signals >= 5
order by weight, edge_type, src, dst limit 50""")
def weak_edges(spark, sf_dir):
    return graph.weak_edges(edges(spark, sf_dir)).select("edge_type", "src", "dst", "weight", "negative_signals")


@query("strong_edges", with_ctes(EDGES_SQL) + """
select edge_type, src, dst, weight from edges where weight >= 0.8 order by weight desc, edge_type, src, dst limit 50""")
def strong_edges(spark, sf_dir):
    return graph.strong_edges(edges(spark, sf_dir)).select("edge_type", "src", "dst", "weight")
