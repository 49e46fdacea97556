"""Lexical, vector and fusion queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymind.catalog.common import HITS_SQL, NOT_WORD, hits, r6, sql_list, table, with_ctes
from quarrymind.functions import text as tx
from quarrymind.functions import vectors as vx
from quarrymind.operators import fusion, lexical, similarity, vector

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------------------------------------------------------------- lexical

def _index_ctes(prefix: str, docs: str) -> str:
    return f"""{prefix}_tok as (
  select doc_id, unnest(list_filter(string_split_regex(lower(text), '{NOT_WORD}+'), lambda x: x <> '')) as term from {docs}),
{prefix}_post as (select term, doc_id, count(*) as tf from {prefix}_tok group by all),
{prefix}_dl as (select d.doc_id, coalesce(n, 0) as dl from {docs} d
  left join (select doc_id, count(*) as n from {prefix}_tok group by 1) using (doc_id)),
{prefix}_st as (select count(*) as n_docs, avg(dl) as avgdl from {prefix}_dl),
{prefix}_df as (select term, count(*) as df from {prefix}_post group by 1)"""


def _bm25_ctes(prefix: str, top: int) -> str:
    return f"""{prefix}_hit as (
  select query_id, doc_id,
         round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from q_terms join {prefix}_post using (term) join {prefix}_df using (term) join {prefix}_dl using (doc_id), {prefix}_st
  group by 1, 2),
{prefix}_top as (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {prefix}_hit
  qualify rank <= {top})"""


QTERMS = f"""q_terms as (
  select distinct item_id as query_id,
         unnest(list_filter(string_split_regex(lower(text), '{NOT_WORD}+'), lambda x: x <> '')) as term from benchmark)"""

BM25_SQL = with_ctes(_index_ctes("b", "documents"), QTERMS, _bm25_ctes("b", 10))


@query("bm25_topk", BM25_SQL + "select query_id, doc_id, round(score, 6) as score, rank from b_top")
def bm25_topk(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.bm25_search(index, _queries(spark, sf_dir), 10).select("query_id", "doc_id", r6("score"), "rank")


@query("bm25_pruned", BM25_SQL + "select query_id, doc_id, round(score, 6) as score, rank from b_top")
def bm25_pruned(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.bm25_search(index, _queries(spark, sf_dir), 10, prune=True).select("query_id", "doc_id", r6("score"), "rank")


@query("bm25_match_all", with_ctes(_index_ctes("b", "documents"), QTERMS) + """,
need as (select query_id, count(*) as n from q_terms group by 1),
scored as (
  select query_id, doc_id, count(*) as matched,
         round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from q_terms join b_post using (term) join b_df using (term) join b_dl using (doc_id), b_st group by 1, 2)
select query_id, doc_id, round(score, 6) as score,
       row_number() over (partition by query_id order by score desc, doc_id) as rank
from scored join need using (query_id) where matched = n qualify rank <= 10""")
def bm25_match_all(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.bm25_search(index, _queries(spark, sf_dir), 10, match="all").select(
        "query_id", "doc_id", r6("score"), "rank"
    )


@query("index_terms", with_ctes(_index_ctes("b", "documents")) + """
select term, df, (select n_docs from b_st) as n_docs, round((select avgdl from b_st), 6) as avgdl from b_df""")
def index_terms(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    stats = index.totals.select(F.struct("n_docs", "avgdl")).scalar()
    return index.terms.select("term", "df", stats["n_docs"].alias("n_docs"), F.round(stats["avgdl"], 6).alias("avgdl"))


_STOP = sql_list(sorted(set(tx.STOP_WORDS)))
KEYWORDS_CTE = f"""
kw_all as (
  select id, word, count(*) as n, min(pos) as first from (
    select id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos
    from (select id, string_split_regex(lower(text), '{NOT_WORD}+') as w from kw_src))
  where length(word) >= 3 and not list_contains({_STOP}, word) group by all),
kw as (
  select id, word, row_number() over (partition by id order by n desc, first) as pos from kw_all qualify pos <= 10)"""

TITLE_SQL = r"""case when text is null or text = '' then '' else coalesce(
  case when regexp_matches(text, '(?m)^#\s+(.+)$') then trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1), E' \t\n\r') end,
  case when regexp_matches(text, '(?i)<title>([^<]+)</title>') then trim(regexp_extract(text, '(?i)<title>([^<]+)</title>', 1), E' \t\n\r') end,
  list_transform(list_filter(list_transform(string_split(trim(text, E' \t\n\r'), E'\n'), lambda x: trim(x, E' \t\n\r')), lambda x: length(x) > 5)[1:1],
     lambda x: case when length(x) > 100 then x[1:100] || '...' else x end)[1],
  'Sin título') end"""


@query("keyword_fallback", "with kw_src as (select item_id as id, text from benchmark)," + KEYWORDS_CTE + """,
n_kw as (select id, count(*) as n_kw from kw group by 1),
cnt as (
  select id, doc_id, pos,
         least(3, (length(low) - length(replace(low, word, ''))) // length(word)) as n
  from kw, (select doc_id, lower(text) as low from documents) where contains(low, word)),
scored as (
  select id, doc_id, round(sum(n) / (n_kw * 3), 9) as score, min(pos) as first
  from cnt join n_kw using (id) group by id, doc_id, n_kw)
select id as query_id, doc_id, round(score, 6) as score,
       row_number() over (partition by id order by score desc, doc_id) as rank
from scored where first <= 5 qualify rank <= 10""")
def keyword_fallback(spark, sf_dir):
    return lexical.keyword_fallback(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10).select(
        "query_id", "doc_id", r6("score"), "rank"
    )


@query("multi_field_search", with_ctes(
    f"titled as (select doc_id, {TITLE_SQL} as text from documents)",
    _index_ctes("b", "documents"), _index_ctes("t", "titled"), QTERMS, _bm25_ctes("b", 20), _bm25_ctes("t", 20)) + """,
both_fields as (
  select query_id, doc_id, round(sum(score), 9) as score from (
    select query_id, doc_id, score from b_top union all select query_id, doc_id, score * 1.5 from t_top) group by 1, 2)
select query_id, doc_id, round(score, 6) as score,
       row_number() over (partition by query_id order by score desc, doc_id) as rank
from both_fields qualify rank <= 10""")
def multi_field_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    indexes = {
        "content": lexical.build_index(docs),
        "title": lexical.build_index(docs.select("doc_id", tx.title("text").alias("text"))),
    }
    return lexical.search_multi_field(indexes, _queries(spark, sf_dir)).select("query_id", "doc_id", r6("score"), "rank")


# ---------------------------------------------------------------- vector

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"


def _cos(a: str, b: str) -> str:
    # Float vectors, scored in double precision.
    return f"round(list_cosine_similarity({a}::double[], {b}::double[]), 9)"


def _query_vectors(spark, sf_dir):
    """The query vector of benchmark item q is embedding q."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


@query("vector_topk", f"""
select query_id, doc_id, round(score, 6) as score, round(1 - score, 6) as distance,
       row_number() over (partition by query_id order by score desc, doc_id) as rank
from (select q.vec_id as query_id, v.vec_id as doc_id, {_cos('q.embedding', 'v.embedding')} as score
      from embeddings q join benchmark on item_id = q.vec_id, embeddings v)
where score >= 0 qualify rank <= 10""")
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.vector_search(vectors, _query_vectors(spark, sf_dir), 10).select(
        "query_id", "doc_id", r6("score"), r6("distance"), "rank"
    )


@query("vector_topk_filtered", f"""
select query_id, doc_id, round(score, 6) as score,
       row_number() over (partition by query_id order by score desc, doc_id) as rank
from (select q.vec_id as query_id, v.vec_id as doc_id, {_cos('q.embedding', 'v.embedding')} as score
      from embeddings q join benchmark on item_id = q.vec_id, embeddings v where v.label % 2 = 0)
where score >= 0.1 qualify rank <= 5""")
def vector_topk_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.vector_search(
        vectors, _query_vectors(spark, sf_dir), 5, min_score=0.1, filters=F.col("label") % 2 == 0
    ).select("query_id", "doc_id", r6("score"), "rank")


@query("similar_items", f"""
select query_id, doc_id, round(score, 6) as score,
       row_number() over (partition by query_id order by score desc, doc_id) as rank
from (select q.vec_id as query_id, v.vec_id as doc_id, {_cos('q.embedding', 'v.embedding')} as score
      from embeddings q, embeddings v where q.vec_id <> v.vec_id)
where score >= 0.2 qualify rank <= 5""")
def similar_items(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.similar_items(vectors, vectors.select("vec_id"), 5, 0.2).select("query_id", "doc_id", r6("score"), "rank")


@query("ivf_topk", f"""
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id) as rank
from (select q.vec_id as query_id, v.vec_id as doc_id, {_cos('q.embedding', 'v.embedding')} as score
      from embeddings q join benchmark on item_id = q.vec_id, embeddings v)
where score >= 0 qualify rank <= 10""")
def ivf_topk(spark, sf_dir):
    """Exact hits from a cell index: cells are left out only where their bound proves that they hold none."""
    cells, centers = vector.build_ivf(table(spark, sf_dir, "embeddings"), 8)
    return vector.cell_search(cells, centers, _query_vectors(spark, sf_dir), 10).select("query_id", "doc_id", r6("score"), "rank")


@query("label_centroids", """
with m as (
  select label, pos, avg(x) as x from (
    select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1, 2),
n as (select label, sqrt(sum(x * x)) as norm from m group by 1),
c as (select label, count(*) as n from embeddings group by 1)
select label, n, pos, round(case when n = 1 then x else x / norm end, 6) as x from m join n using (label) join c using (label)""")
def label_centroids(spark, sf_dir):
    means = vector.avg_embedding(table(spark, sf_dir, "embeddings"), "label", order="vec_id")
    return means.select("label", "n", F.posexplode("embedding").alias("pos", "x")).select("label", "n", "pos", r6("x"))


@query("vector_measures", """
with c as (select label, vec_id, embedding from embeddings),
f as (select label, arg_min(embedding, vec_id) as head from embeddings group by 1)
select vec_id,
       round(list_cosine_similarity(embedding::double[], head::double[]), 6) as cosine,
       round(list_distance(embedding::double[], head::double[]), 6) as euclidean,
       round(list_inner_product(embedding::double[], head::double[]), 6) as dot,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm
from c join f using (label)""")
def vector_measures(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    a, b = F.col("embedding"), F.col("head")
    return vectors.join(heads, "label").select(
        "vec_id", r6(vx.cosine(a, b), "cosine"), r6(vx.euclidean(a, b), "euclidean"),
        r6(vx.dot(a, b), "dot"), r6(vx.norm(a), "norm"),
    )


@query("unit_vectors", """
select vec_id, pos, round(x / norm, 6) as x from (
  select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos,
         sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) as norm from embeddings)""")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vx.l2_normalize(F.col("embedding"))).alias("pos", "x")
    ).select("vec_id", "pos", r6("x"))


# ---------------------------------------------------------------- normalise and fuse

_MINMAX = """nrm as (
  select *, case when hi = lo then 0.5 else (score - lo) / (hi - lo) end as norm from (
    select *, min(score) over w as lo, max(score) over w as hi from hits window w as (partition by query_id, source)))"""
_H = "query_id, source, rank, doc_id"


@query("normalize_minmax", with_ctes(HITS_SQL, _MINMAX) + f"select {_H}, round(norm, 6) as norm from nrm")
def normalize_minmax(spark, sf_dir):
    return fusion.normalize_scores(hits(spark, sf_dir), "minmax").select("query_id", "source", "rank", "doc_id", r6("norm"))


@query("normalize_zscore", with_ctes(HITS_SQL) + f"""
select {_H}, round(1 / (1 + exp(-(score - a) / case when s > 0 then s else 1 end)), 6) as norm from (
  select *, avg(score) over w as a, stddev_pop(score) over w as s from hits window w as (partition by query_id, source))""")
def normalize_zscore(spark, sf_dir):
    return fusion.normalize_scores(hits(spark, sf_dir), "zscore").select("query_id", "source", "rank", "doc_id", r6("norm"))


@query("normalize_rank", with_ctes(HITS_SQL) + f"""
select {_H}, round(case when n = 1 then 1.0 else (n - rank) / (n - 1) end, 6) as norm from (
  select *, count(*) over (partition by query_id, source) as n from hits)""")
def normalize_rank(spark, sf_dir):
    return fusion.normalize_scores(hits(spark, sf_dir), "rank").select("query_id", "source", "rank", "doc_id", r6("norm"))


_OWN = """round(coalesce(arg_max(norm, rank) filter (source = 'vector'), 0), 6) as vector_score,
       round(coalesce(arg_max(norm, rank) filter (source = 'bm25'), 0), 6) as bm25_score,
       round(coalesce(arg_max(norm, rank) filter (source = 'graph'), 0), 6) as graph_score,
       string_agg(distinct source, '|' order by source) as sources"""
_WEIGHT = "case source when 'vector' then 0.5 when 'bm25' then 0.3 when 'graph' then 0.2 else 0.1 end"
_FUSED = "select query_id, doc_id, round(final_score, 6) as final_score, vector_score, bm25_score, graph_score, sources, rank from r"


def _fused(df):
    return df.select(
        "query_id", "doc_id", r6("final_score"), r6("vector_score"), r6("bm25_score"), r6("graph_score"),
        F.array_join("sources", "|").alias("sources"), "rank",
    )


FUSE_WEIGHTED_CTES = (HITS_SQL, _MINMAX, f"""f as (
  select query_id, doc_id, round(sum(norm * {_WEIGHT}), 9) as final_score, {_OWN} from nrm group by 1, 2),
r as (select *, row_number() over (partition by query_id order by final_score desc, doc_id) as rank
      from f where final_score >= 0.2 qualify rank <= 30)""")


@query("fuse_weighted", with_ctes(*FUSE_WEIGHTED_CTES) + _FUSED)
def fuse_weighted(spark, sf_dir):
    return _fused(fusion.fuse(hits(spark, sf_dir), "weighted", min_final=0.2, max_results=30))


@query("fuse_rrf", with_ctes(HITS_SQL, f"""nrm as (select *, 1 / (60.0 + rank) as norm from hits),
f as (select query_id, doc_id, round(sum(norm), 9) as final_score, {_OWN} from nrm group by 1, 2),
r as (select *, row_number() over (partition by query_id order by final_score desc, doc_id) as rank
      from f qualify rank <= 30)""") + _FUSED + " where final_score >= 0.01")
def fuse_rrf(spark, sf_dir):
    return _fused(fusion.fuse(hits(spark, sf_dir), "rrf", min_final=0.01, max_results=30))


@query("fuse_max", with_ctes(HITS_SQL, _MINMAX, f"""f as (
  select query_id, doc_id, round(max(norm), 9) as final_score,
       round(coalesce(max(norm) filter (source = 'vector'), 0), 6) as vector_score,
       round(coalesce(max(norm) filter (source = 'bm25'), 0), 6) as bm25_score,
       round(coalesce(max(norm) filter (source = 'graph'), 0), 6) as graph_score,
       string_agg(distinct source, '|' order by source) as sources from nrm group by 1, 2),
r as (select *, row_number() over (partition by query_id order by final_score desc, doc_id) as rank
      from f qualify rank <= 30)""") + _FUSED + " where final_score >= 0.3")
def fuse_max(spark, sf_dir):
    return _fused(fusion.fuse(hits(spark, sf_dir), "max", min_final=0.3, max_results=30))


@query("adapt_weights", with_ctes(HITS_SQL) + """
select query_id, round((0.5 + count(*) filter (source = 'vector') / count(*)) / 2, 6) as vector_weight,
       round((0.3 + count(*) filter (source = 'bm25') / count(*)) / 2, 6) as bm25_weight,
       round((0.2 + count(*) filter (source = 'graph') / count(*)) / 2, 6) as graph_weight
from hits group by 1""")
def adapt_weights(spark, sf_dir):
    return fusion.adapt_weights(hits(spark, sf_dir)).select(
        "query_id", r6("vector_weight"), r6("bm25_weight"), r6("graph_weight")
    )


@query("fuse_adaptive", with_ctes(HITS_SQL, _MINMAX, """aw as (
  select query_id, (0.5 + count(*) filter (source = 'vector') / count(*)) / 2 as vw,
       (0.3 + count(*) filter (source = 'bm25') / count(*)) / 2 as bw,
       (0.2 + count(*) filter (source = 'graph') / count(*)) / 2 as gw from hits group by 1)""") + """
select query_id, doc_id, round(final_score, 6) as final_score,
       row_number() over (partition by query_id order by final_score desc, doc_id) as rank
from (select query_id, doc_id, round(sum(norm * case source when 'vector' then vw when 'bm25' then bw else gw end), 9) as final_score
      from nrm join aw using (query_id) group by 1, 2) qualify rank <= 10""")
def fuse_adaptive(spark, sf_dir):
    rows = hits(spark, sf_dir)
    weighted = rows.join(fusion.adapt_weights(rows), "query_id")
    return fusion.fuse(weighted, "weighted", max_results=10).select("query_id", "doc_id", r6("final_score"), "rank")


@query("adaptive_threshold", with_ctes(HITS_SQL) + """,
lim as (select query_id, count(*) as n, max(score) filter (rn = 5) as nth from (
  select query_id, score, row_number() over (partition by query_id order by score desc) as rn from hits) group by 1)
select query_id, source, rank, doc_id, score, case when n > 5 then greatest(nth, 0.3) else 0.3 end as threshold
from hits join lim using (query_id) where n <= 5 or score >= greatest(nth, 0.3)""")
def adaptive_threshold(spark, sf_dir):
    return vector.adaptive_threshold(hits(spark, sf_dir), 5, 0.3).select(
        "query_id", "source", "rank", "doc_id", "score", "threshold"
    )


@query("filter_threshold", """
select query_id, doc_id, round(score, 6) as score from (
  select event_id as query_id, user_id as doc_id, value / 100 as score from events) where score >= 0.2 and 1 - score <= 0.6""")
def filter_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), F.col("user_id").alias("doc_id"), (F.col("value") / 100).alias("score")
    )
    return vector.filter_threshold(rows, 0.2, 0.6).select("query_id", "doc_id", r6("score"))


@query("boosts", """
with m as (select user_id as query_id, event_id as doc_id, value as score,
                  (props->>'$.k')::int % 3 as k3, event_type = 'click' as is_click from events)
select query_id, doc_id, round(score * case when k3 <> 0 then 1.5 else 1 end * case when is_click then 1.2 else 1 end, 6) as final_score,
       row_number() over (partition by query_id order by
         round(score * case when k3 <> 0 then 1.5 else 1 end * case when is_click then 1.2 else 1 end, 9) desc, doc_id) as rank
from m""")
def boosts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("final_score"),
        F.to_json(F.struct(
            (F.get_json_object("props", "$.k").cast("int") % 3).alias("k3"),
            F.struct((F.col("event_type") == "click").alias("click")).alias("kind"),
        )).alias("metadata"),
    )
    return fusion.apply_boosts(rows, {"metadata.k3": 1.5, "metadata.kind.click": 1.2}).select(
        "query_id", "doc_id", r6("final_score"), "rank"
    )


def _ranked_texts(spark, sf_dir, limit: int = 30):
    """Fused hits of every user with document texts."""
    fused = fusion.fuse(hits(spark, sf_dir), "weighted", min_final=0.2, max_results=limit)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return fused.join(docs, "doc_id")


@query("select_top_k", with_ctes(*FUSE_WEIGHTED_CTES) + """
select query_id, doc_id, round(final_score, 6) as final_score,
       row_number() over (partition by query_id order by final_score desc, doc_id) as rank
from r where final_score >= 0.25 qualify rank <= 5""")
def select_top_k(spark, sf_dir):
    fused = fusion.fuse(hits(spark, sf_dir), "weighted", min_final=0.2, max_results=30)
    return fusion.select_top_k(fused, 5, 0.25).select("query_id", "doc_id", r6("final_score"), "rank")


# The kept ids so far travel down the ranks; a hit joins unless it is too like one of them.
_WORDS_CTE = r"""wd as (
  select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from documents),
near as materialized (select distinct x.doc_id as a, y.doc_id as b from r x join r y using (query_id) where x.doc_id <> y.doc_id),
sim as materialized (
  select a, b, len(list_intersect(p.w, q.w)) / (len(p.w) + len(q.w) - len(list_intersect(p.w, q.w))) as s
  from near join wd p on p.doc_id = a join wd q on q.doc_id = b)"""


@query("dedup_hits", "with recursive " + ",\n".join(FUSE_WEIGHTED_CTES) + "," + _WORDS_CTE + """,
walk as (
  select query_id, 0::bigint as rank, []::bigint[] as kept from r group by 1
  union all
  select walk.query_id, r.rank,
         case when exists (select 1 from sim where sim.a = r.doc_id and list_contains(walk.kept, sim.b) and s >= 0.3)
              then kept else list_append(kept, r.doc_id) end
  from walk join r on r.query_id = walk.query_id and r.rank = walk.rank + 1),
fin as (select query_id, arg_max(kept, rank) as kept from walk group by 1)
select query_id, unnest(kept) as doc_id, unnest(range(1, len(kept) + 1)) as rank from fin""")
def dedup_hits(spark, sf_dir):
    return fusion.dedup_hits(_ranked_texts(spark, sf_dir), 0.3).select("query_id", "doc_id", "rank")


@query("near_duplicates", r"""with recursive wd as materialized (
  select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from documents),
sim as materialized (
  select a, b, i / (m + n - i) as s from (
    select x.doc_id as a, y.doc_id as b, len(x.w) as m, len(y.w) as n, len(list_intersect(x.w, y.w)) as i
    from wd x join wd y on x.doc_id < y.doc_id and least(len(x.w), len(y.w)) >= 0.89 * greatest(len(x.w), len(y.w)) and len(x.w) > 0)
  where i / (m + n - i) >= 0.9),
seq as materialized (select doc_id, row_number() over (order by doc_id) as rn from documents),
walk as (
  select 0::bigint as rn, []::bigint[] as kept
  union all
  select seq.rn, case when exists (select 1 from sim where b = seq.doc_id and list_contains(kept, a)) then kept else list_append(kept, seq.doc_id) end
  from walk join seq on seq.rn = walk.rn + 1),
fin as materialized (select unnest(arg_max(kept, rn)) as k from walk)
select doc_id, coalesce(r.a, doc_id) as representative, round(coalesce(r.s, 1), 6) as similarity, r.a is null as kept
from documents left join (
  select b, min(a) as a, arg_min(s, a) as s from sim where a in (select k from fin) and b not in (select k from fin) group by 1) r on b = doc_id""")
def near_duplicates(spark, sf_dir):
    return similarity.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "representative", r6("similarity"), "kept")


@query("mmr_select", "with recursive " + ",\n".join(FUSE_WEIGHTED_CTES) + "," + _WORDS_CTE + """,
walk as (
  select query_id, 1::bigint as step, [doc_id] as picked from r where rank = 1
  union all
  select query_id, step + 1, list_append(picked, doc_id) from (
    select w.query_id, w.step, w.picked, r.doc_id,
           row_number() over (partition by w.query_id order by
             r.final_score - 0.5 * (select max(s) from sim where sim.a = r.doc_id and list_contains(w.picked, sim.b)) desc, r.rank) as o
    from walk w join r on r.query_id = w.query_id and not list_contains(w.picked, r.doc_id) where w.step < 5)
  where o = 1),
fin as (select query_id, arg_max(picked, step) as picked from walk group by 1)
select query_id, unnest(picked) as doc_id, unnest(range(1, len(picked) + 1)) as rank from fin""")
def mmr_select(spark, sf_dir):
    return fusion.mmr(_ranked_texts(spark, sf_dir), 5, 0.5).select("query_id", "doc_id", "rank")


@query("context_budget", with_ctes(*FUSE_WEIGHTED_CTES) + """,
c as (select r.*, text as content, sum(length(text) // 4) over (partition by query_id order by rank) as used
      from r join documents using (doc_id))
select query_id, count(*) as n_hits, max(used)::bigint as tokens,
       md5(string_agg('[' || rank || '] (score: ' || format('{:.2f}', final_score) || ', ' ||
         coalesce(nullif(concat_ws(', ', case when vector_score > 0 then 'vector: ' || format('{:.2f}', vector_score) end,
                         case when bm25_score > 0 then 'bm25: ' || format('{:.2f}', bm25_score) end,
                         case when graph_score > 0 then 'graph: ' || format('{:.2f}', graph_score) end), ''), 'combined') || E')\\n' || content,
         E'\\n\\n---\\n\\n' order by rank)) as context
from c where used <= 4000 group by 1""")
def context_budget(spark, sf_dir):
    rows = _ranked_texts(spark, sf_dir)
    for c in ("vector_score", "bm25_score", "graph_score"):
        rows = rows.withColumn(c, F.round(c, 6))
    return fusion.build_context(rows, 4000).select("query_id", "n_hits", "tokens", F.md5("context").alias("context"))
