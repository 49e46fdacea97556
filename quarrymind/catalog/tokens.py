"""Queries that count tokens by byte-pair merging under a vocabulary file."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

from quarrymind.catalog.common import table
from quarrymind.catalog.documents import SENT_SQL, _PARTS, pack_ctes
from quarrymind.functions import text as tx
from quarrymind.functions.bpe import BytePairs
from quarrymind.operators import chunking as ch
from quarrymind.operators import documents as dm

QUERIES: dict = {}
ORACLES: dict = {}
#: The vocabulary that the queries count with; a parameter of the library, any file of this form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn
    return register


@lru_cache(maxsize=4)
def _tokens_of(application: str, path: str) -> BytePairs:
    return BytePairs(SparkSession.getActiveSession(), path)


def tokens(spark: SparkSession) -> BytePairs:
    """The estimator, read once per application."""
    return _tokens_of(spark.sparkContext.applicationId, VOCABULARY)


def bpe_ctes(texts: str) -> str:
    """Costs ``n`` of each piece of the column ``t`` of ``texts``: the best pair of every piece is merged in each step, all pieces at once."""
    return rf"""ranks as materialized (
  select lower(hex(from_base64(token))) as h, rank
  from read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', columns = {{'token': 'varchar', 'rank': 'bigint'}})),
pieces as materialized (
  select t, unnest(regexp_extract_all(regexp_replace(t, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+')) as piece from (select distinct t from {texts})),
bytes as (select piece, lower(hex(encode(piece))) as h from (select distinct piece from pieces)),
parts as (
  select 0::bigint as step, piece, unnest(range(len(h) // 2)) as pos, unnest(list_transform(range(len(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2])) as tok from bytes
  union all
  select step + 1, piece, pos - (pos > best % 100000)::bigint, case when pos = best % 100000 then tok || after else tok end
  from (select *, min(rank * 100000 + pos) over (partition by piece) as best
        from (select p.*, lead(tok) over (partition by piece order by pos) as after from parts p) left join ranks on h = tok || after)
  where best is not null and pos <> best % 100000 + 1),
merged as materialized (select piece, count(*) filter (step = 0) - max(step) as n from parts group by 1),
costs as materialized (select t, sum(n)::bigint as n from pieces join merged using (piece) group by 1)"""


@query("bpe_token_counts", f"""with recursive texts as (select text as t from documents), {bpe_ctes('texts')}
select doc_id, coalesce(n, 0) as token_count from documents left join costs on t = text""")
def bpe_token_counts(spark, sf_dir):
    return dm.with_token_count(table(spark, sf_dir, "documents"), tokens=tokens(spark)).select("doc_id", F.col("token_count").cast("long").alias("token_count"))


PRE = """pre as materialized (
  select doc_id, s, len(s) as n, list_prepend(0::bigint, p) as p from sent join (
    select doc_id, list(used order by i) as p from (
      select doc_id, i, sum(n) over (partition by doc_id order by i)::bigint as used
      from (select doc_id, unnest(s) as t, unnest(range(len(s))) as i from sent) join costs using (t)) group by 1) using (doc_id))"""


@query("bpe_chunks", f"""with recursive sent as materialized (select doc_id, {SENT_SQL} as s from documents),
texts as (select unnest(s) as t from sent), {bpe_ctes('texts')},
{pack_ctes(128, 30, pre=PRE)}
select doc_id, k as chunk_index, md5(array_to_string(s[first + 1 : last], ' ')) as content, p[last + 1] - p[first + 1] as sentence_tokens
from chunk join pre using (doc_id)""")
def bpe_chunks(spark, sf_dir):
    """Chunks of whole sentences of up to 128 tokens, and the tokens of their sentences."""
    own = tokens(spark)
    rows = ch.chunk_overlapping(table(spark, sf_dir, "documents"), size=128, overlap=30, tokens=own).drop("token_count")
    costs = F.aggregate(own.each(tx.sentences("content")), F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.withColumn("sentence_tokens", costs).withColumn("content", F.md5("content"))


@query("bpe_truncate_sentences", f"""with recursive p as materialized (select doc_id, text, {_PARTS.format(x='text')} as parts from documents),
texts as (select unnest(parts) as t from p union all select text from p), {bpe_ctes('texts')},
s as (select doc_id, unnest(parts) as t, unnest(range(1, len(parts) + 1)) as i from p),
c as (select doc_id, i, sum(coalesce(n, 0)) over (partition by doc_id order by i) as used from s left join costs using (t)),
k as (select doc_id, greatest(2, coalesce(max(i) filter (used <= 100), 0)) as kept from c group by 1)
select doc_id, md5(case when coalesce(n, 0) <= 100 then text else array_to_string(parts[:kept], ' ') end) as text
from p join k using (doc_id) left join costs on t = text""")
def bpe_truncate_sentences(spark, sf_dir):
    cut = dm.truncate_sentences(table(spark, sf_dir, "documents"), 100, 2, tokens=tokens(spark))
    return cut.select("doc_id", F.md5("text").alias("text"))
