"""Document, page and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymind.catalog.common import NOT_WORD, r6, table
from quarrymind.catalog.retrieval import KEYWORDS_CTE, TITLE_SQL
from quarrymind.functions import text as tx
from quarrymind.functions.rows import unfold
from quarrymind.operators import chunking as ch
from quarrymind.operators import documents as dm

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# White space of Python's and Java's Unicode class, spelled for RE2.
S = r"[\s\x{0B}\x{85}\p{Z}]"
S1 = r"[\t\r\f\x{0B}\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def clean_ws_sql(x: str) -> str:
    inner = f"regexp_replace(regexp_replace({x}, '{S1}*\\n{S1}*', E'\\n', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')"
    return strip_sql(inner)


def normalize_sql(x: str) -> str:
    """No text here has compatibility characters, for which SQL has no normal form."""
    inner = rf"regexp_replace(regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g'), '[–—]', '-', 'g')"
    return clean_ws_sql(inner)


def markdown_sql(x: str) -> str:
    for pattern, replacement in tx.MARKDOWN_STEPS:
        pattern = pattern.replace("(?sU)", "(?s)").replace("(?mdU)", "(?m)")
        pattern = pattern.replace(r"[\w]", r"[\w\p{L}]")
        to = replacement.replace("$1", r"\1").replace("\n", "\\n")
        quoted = f"E'{to}'" if "\\n" in to else f"'{to}'"
        x = f"regexp_replace({x}, '{pattern}', {quoted}, 'g')"
    return strip_sql(x)


def html_sql(x: str) -> str:
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    for tag, to in (("h1", "# \\\\1\\n"), ("h2", "## \\\\1\\n"), ("h3", "### \\\\1\\n"), ("p", "\\\\1\\n\\n")):
        x = f"regexp_replace({x}, '(?i)<{tag}[^>]*>([^<]+)</{tag}>', E'{to}', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', E'\\n', 'g')"
    x = f"regexp_replace({x}, '(?i)<li[^>]*>([^<]+)</li>', E'- \\\\1\\n', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in tx.HTML_ENTITIES:
        char = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{char}')"
    return x


WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"

# Documents as markdown: a heading, quoted and bulleted lines, marks and links around their text.
MD_SQL = """md as (select doc_id, '# ' || source || chr(10) || '> **' || lang || '** `' || doc_id || '`' || chr(10) || chr(10) || chr(10) || chr(10)
   || '* [' || source || '](http://x/' || doc_id || ')' || chr(10) || doc_id % 7 || '. _note_' || chr(10) || '---' || chr(10)
   || '```' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '##' || lang || chr(10) || '  +  item' || chr(10) || text as text from documents)"""


def markdown_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i, nl = F.col("doc_id").cast("string"), F.lit("\n")
    return d.select("doc_id", F.concat(
        F.lit("# "), F.col("source"), nl, F.lit("> **"), F.col("lang"), F.lit("** `"), i, F.lit("`"), nl, nl, nl, nl,
        F.lit("* ["), F.col("source"), F.lit("](http://x/"), i, F.lit(")"), nl, (F.col("doc_id") % 7).cast("string"),
        F.lit(". _note_\n---\n```\nx = 1\n```\n##"), F.col("lang"), F.lit("\n  +  item\n"), F.col("text"),
    ).alias("text"))


@query("normalize_docs", f"select doc_id, md5({normalize_sql('text')}) as text from documents")
def normalize_docs(spark, sf_dir):
    return dm.normalize_docs(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text"))


# Lines padded with spaces and tabs, with runs of empty lines between them.
@query("clean_whitespace", f"""select doc_id, md5({clean_ws_sql("replace(text, '. ', E'. \\t \\n  \\n \\t\\n\\n  ')")}) as text from documents""")
def clean_whitespace(spark, sf_dir):
    padded = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(". \t \n  \n \t\n\n  ")))
    return dm.clean_whitespace(padded).select("doc_id", F.md5("text").alias("text"))


@query("strip_markdown", f"with {MD_SQL} select doc_id, md5({markdown_sql('text')}) as text from md")
def strip_markdown(spark, sf_dir):
    return dm.strip_markdown(markdown_docs(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query("html_to_text", f"select page_id, md5({normalize_sql(html_sql('html'))}) as text from pages")
def html_to_text(spark, sf_dir):
    return dm.html_to_text(table(spark, sf_dir, "pages")).select("page_id", F.md5("text").alias("text"))


_MD_TAIL = r"""regexp_replace(regexp_replace({x}, '(?m)^(#{{1,6}})\s*', '\1 ', 'g'), '(?m)^(\s*)[-*+](\s+)', '\1- ', 'g')"""


@query("normalize_markdown", f"with {MD_SQL} select doc_id, md5({_MD_TAIL.format(x=normalize_sql('text'))}) as text from md")
def normalize_markdown(spark, sf_dir):
    return dm.normalize_markdown(markdown_docs(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query("clean_text", f"with {MD_SQL} select doc_id, md5({markdown_sql(normalize_sql('text'))}) as text from md")
def clean_text(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", F.md5(tx.clean_text("text")).alias("text"))


# Pages as HTML, documents as markdown and plain text, together.
MIXED_SQL = MD_SQL + """, mixed as (
  select 'page-' || page_id as id, html as text from pages
  union all select 'md-' || doc_id, text from md union all select 'doc-' || doc_id, text from documents)"""
TYPE_SQL = f"""case when coalesce(text, '') = '' then 'unknown'
  when regexp_matches(lower({strip_sql('text')}), '^(<!doctype|<html|<head|<body)') then 'html'
  when regexp_matches(text, '(?m)^#{{1,6}}\\s')::int + regexp_matches(text, '\\*\\*[^*]+\\*\\*')::int + regexp_matches(text, '\\[.+\\]\\(.+\\)')::int
     + regexp_matches(text, '(?m)^[-*+]\\s')::int + contains(text, '```')::int >= 2 then 'markdown' else 'text' end"""


def mixed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text"))
    md = markdown_docs(spark, sf_dir).select(F.concat(F.lit("md-"), "doc_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    return pages.unionByName(md).unionByName(docs)


@query("content_types", f"with {MIXED_SQL} select id, {TYPE_SQL} as content_type from mixed")
def content_types(spark, sf_dir):
    return dm.with_content_type(mixed(spark, sf_dir)).select("id", "content_type")


# Each page's URL with an extension, and each document as a file name.
_EXT = "['pdf','MP3','webm','html','md','txt','docx','mkv','htm','xyz']"


@query("content_types_by_name", f"""
select 'u' || page_id as id, case regexp_extract(lower(p), '\\.([a-z0-9]+)$', 1) when 'pdf' then 'pdf' when 'mp3' then 'audio' when 'webm' then 'video' else 'url' end as content_type
from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '.' || ({_EXT})[page_id % 10 + 1] as p from pages)
union all
select 'f' || doc_id, case e when 'pdf' then 'pdf' when 'MP3' then 'audio' when 'webm' then 'video' when 'html' then 'html' when 'md' then 'markdown'
  when 'txt' then 'text' when 'docx' then 'docx' when 'mkv' then 'video' when 'htm' then 'html' else t end
from (select doc_id, ({_EXT})[doc_id % 10 + 1] as e, {TYPE_SQL} as t from documents)""")
def content_types_by_name(spark, sf_dir):
    ext = F.array(*[F.lit(x) for x in ("pdf", "MP3", "webm", "html", "md", "txt", "docx", "mkv", "htm", "xyz")])
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("u"), "page_id").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("path"),
        F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("."), F.element_at(ext, (F.col("page_id") % 10 + 1).cast("int")), F.lit("?x=1")).alias("url"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), "doc_id").alias("id"), "text",
        F.concat(F.lit("/in/file."), F.element_at(ext, (F.col("doc_id") % 10 + 1).cast("int"))).alias("path"), F.lit(None).cast("string").alias("url"),
    )
    return dm.with_content_type(pages.unionByName(docs), "text", "path", "url").select("id", "content_type")


PROCESSED_SQL = MIXED_SQL + f""", typed as (select *, {TYPE_SQL} as content_type from mixed),
processed as (select id, content_type, {TITLE_SQL} as title, case content_type
    when 'html' then {normalize_sql(html_sql('text'))}
    when 'markdown' then {_MD_TAIL.format(x=normalize_sql('text'))} else {normalize_sql('text')} end as normalized from typed)"""


@query("process_documents", f"with {PROCESSED_SQL} select id, content_type, title, md5(normalized) as normalized, len({WORDS.format(x='normalized')}) as word_count from processed")
def process_documents(spark, sf_dir):
    return dm.process_documents(mixed(spark, sf_dir)).select(
        "id", "content_type", "title", F.md5("normalized").alias("normalized"), F.col("word_count").cast("long").alias("word_count")
    )


@query("validate_docs", f"""with {PROCESSED_SQL}, n as (select id, title, normalized, len({WORDS.format(x='normalized')}) as n from processed)
select id, case when normalized = '' then 'Contenido normalizado vacío' when n < 40 then 'Contenido muy corto: ' || n || ' palabras'
  when title = '' then 'Título no detectado' end as error from n""")
def validate_docs(spark, sf_dir):
    return dm.validate_docs(dm.process_documents(mixed(spark, sf_dir)), min_words=40).select("id", "error")


@query("titles", f"with {MIXED_SQL} select id, {TITLE_SQL} as title from mixed")
def titles(spark, sf_dir):
    return dm.with_title(mixed(spark, sf_dir)).select("id", "title")


@query("file_titles", """select p_partkey, array_to_string(list_transform(string_split(replace(lower(p_name), '-', ' ') || ' ' || lower(p_type), ' '),
  lambda w: upper(w[1]) || w[2:]), ' ') as title from part""")
def file_titles(spark, sf_dir):
    path = F.concat(F.lit("/docs/"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("-"), F.lower("p_type"), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_from_path(path).alias("title"))


@query("token_counts", "select doc_id, length(text) // 4 as token_count from documents")
def token_counts(spark, sf_dir):
    return dm.with_token_count(table(spark, sf_dir, "documents")).select("doc_id", "token_count")


@query("keywords", "with kw_src as (select doc_id as id, text from documents)," + KEYWORDS_CTE + """
select doc_id, coalesce(k, '') as keywords from documents left join (select id, string_agg(word, '|' order by pos) as k from kw group by 1) on id = doc_id""")
def keywords(spark, sf_dir):
    return dm.keywords(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@query("jaccard", f"""with w as (select conv_id, turn, list_distinct({WORDS.format(x='lower(text)')}) as w from conversations)
select a.conv_id, a.turn, round(case when len(a.w) > 0 and len(b.w) > 0 then
  len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) else 0 end, 6) as overlap
from w a join w b on b.conv_id = a.conv_id and b.turn = a.turn + 1""")
def jaccard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", r6(tx.jaccard("text", "reply"), "overlap"))


_CUT = "case when length(text) // 4 <= 60 then text else {cut} end"


@query("truncate_texts", f"""select doc_id, md5({_CUT.format(cut="text[:236] || '...'")}) as at_end, md5({_CUT.format(cut="'...' || right(text, 236)")}) as at_start,
  md5({_CUT.format(cut="text[:116] || '...' || right(text, 120)")}) as in_middle from documents""")
def truncate_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.truncate("text", 60, "end")).alias("at_end"), F.md5(tx.truncate("text", 60, "start")).alias("at_start"),
        F.md5(tx.truncate("text", 60, "middle")).alias("in_middle"),
    )


_PARTS = r"string_split(regexp_replace({x}, '([.!?])\s+', E'\\1\x1e', 'g'), E'\x1e')"
SENT_SQL = f"list_filter(list_transform({_PARTS.format(x='text')}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


@query("truncate_sentences", f"""with p as (select doc_id, text, {_PARTS.format(x='text')} as parts from documents),
s as (select doc_id, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from p),
c as (select doc_id, i, sum(length(part) // 4) over (partition by doc_id order by i) as used from s),
k as (select doc_id, greatest(2, coalesce(max(i) filter (used <= 100), 0)) as kept from c group by 1)
select doc_id, md5(case when length(text) // 4 <= 100 then text else array_to_string(parts[:kept], ' ') end) as text from p join k using (doc_id)""")
def truncate_sentences(spark, sf_dir):
    return dm.truncate_sentences(table(spark, sf_dir, "documents"), 100, 2).select("doc_id", F.md5("text").alias("text"))


@query("sentences", f"""select doc_id, unnest(s) as sentence, unnest(range(0, len(s))) as pos from (select doc_id, {SENT_SQL} as s from documents)""")
def sentences(spark, sf_dir):
    return unfold(dm.with_sentences(table(spark, sf_dir, "documents")), ["doc_id"], "sentences", "sentence", "pos")


@query("split_sections", """select doc_id, unnest(p) as part, unnest(range(0, len(p))) as pos from (
  select doc_id, list_filter(string_split(replace(replace(text, chr(10), chr(10) || chr(30)), ', ', ', ' || chr(30)), chr(30)), lambda x: trim(x, E' \\n\\t') <> '') as p from documents)""")
def split_sections(spark, sf_dir):
    return unfold(dm.split_by(table(spark, sf_dir, "documents"), ["\n", ", "]), ["doc_id"], "parts", "part", "pos")


_META = r"""[+\-&|!(){}\[\]^"~*?:\\]"""


@query("prepare_queries", f"""select item_id, q as text from (select item_id,
  {strip_sql(f"regexp_replace(regexp_replace({markdown_sql('t')}, '{_META}', ' ', 'g'), '{S}+', ' ', 'g')")} as q
  from (select item_id, '**What** is (' || text || ')? +a -b [x](y) "z"~2' as t from benchmark)) where q <> ''""")
def prepare_queries(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("**What** is ("), "text", F.lit(')? +a -b [x](y) "z"~2')).alias("text"))
    return dm.prepare_queries(q)


# Replies searched for the words of the question before them.
@query("highlights", f"""with q as (select a.conv_id, a.turn, b.text as content, lower(b.text) as low,
    list_filter({WORDS.format(x='lower(a.text)')}, lambda t: length(t) >= 3) as terms
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
t as (select conv_id, turn, content, low, unnest(terms) as term, unnest(range(0, len(terms))) as ti from q),
g as (select conv_id, turn, content, term, ti, string_split(low, term) as parts from t where contains(low, term)),
o as (select conv_id, turn, content, term, ti, unnest(range(1, len(parts))) as m, parts from g),
p as (select *, list_sum(list_transform(parts[:m], lambda x: length(x)))::bigint + (m - 1) * length(term) as pos from o),
s as (select conv_id, turn, ti, m, case when pos > 100 then '...' else '' end
   || content[greatest(0, pos - 100) + 1 : least(length(content), pos + length(term) + 100)]
   || case when pos + length(term) + 100 < length(content) then '...' else '' end as passage from p),
d as (select conv_id, turn, passage, min(ti * 1000000 + m) as first from s group by 1, 2, 3),
r as (select *, row_number() over (partition by conv_id, turn order by first) as rank from d qualify rank <= 3)
select conv_id, turn, rank, md5(passage) as passage from r""")
def highlights(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("query").alias("content"))
    return unfold(dm.highlights(c.join(after, ["conv_id", "turn"])), ["conv_id", "turn"], "highlights", "p", "pos").select(
        "conv_id", "turn", (F.col("pos") + 1).alias("rank"), F.md5("p").alias("passage")
    )


@query("snippets", """select doc_id, case when length(text) <= 200 then text else
  case when contains(h, ' ') and 200 - instr(reverse(h), ' ') > 140 then h[:200 - instr(reverse(h), ' ')] else h end || '...' end as snippet
from (select doc_id, text, text[:200] as h from documents)""")
def snippets(spark, sf_dir):
    return dm.snippet(table(spark, sf_dir, "documents")).select("doc_id", "snippet")


@query("content_hashes", "select md5(text)[:12] as content_hash, count(*) as copies, min(doc_id) as first_doc from documents group by 1")
def content_hashes(spark, sf_dir):
    return dm.with_content_hash(table(spark, sf_dir, "documents")).groupBy("content_hash").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    )


# ---------------------------------------------------------------- chunks

# `cost` holds prefix sums; each step closes one chunk and finds where the next begins.
def pack_ctes(size: int, overlap: int, src: str = "documents", key: str = "doc_id", pre: str | None = None) -> str:
    pre = pre or f"""sent as materialized (select {key}, {SENT_SQL} as s from {src}),
pre as materialized (select {key}, s, len(s) as n, list_transform(range(0, len(s) + 1),
   lambda i: coalesce(list_sum(list_transform(s[:i], lambda x: length(x) // 4)), 0)::bigint) as p from sent where len(s) > 0)"""
    return f"""{pre},
chunk as (
  select {key}, 0::bigint as k, 0::bigint as first, 0::bigint as floor_at,
    coalesce((select min(j) from (select unnest(range(1, n)) as j) where p[j + 2] - p[1] > {size}), n) as last from pre
  union all
  select {key}, k + 1, nf, last, coalesce((select min(j) from (select unnest(range(last + 1, n)) as j) where p[j + 2] - p[nf + 1] > {size}), n)
  from (select c.{key}, c.k, c.last, n, p, (select min(j) from (select unnest(range(c.first, c.last + 1)) as j) where p[c.last + 1] - p[j + 1] <= {overlap}) as nf
        from chunk c join pre using ({key}) where c.last < n))"""


@query("chunk_overlapping", f"with recursive {pack_ctes(128, 30)}" + """
select doc_id, k as chunk_index, md5(array_to_string(s[first + 1 : last], ' ')) as content, length(array_to_string(s[first + 1 : last], ' ')) // 4 as token_count
from chunk join pre using (doc_id)""")
def chunk_overlapping(spark, sf_dir):
    return ch.chunk_overlapping(table(spark, sf_dir, "documents"), size=128, overlap=30).withColumn("content", F.md5("content"))


@query("simple_chunk", f"with recursive {pack_ctes(256, 50)}" + """,
c as (select doc_id, k, array_to_string(s[first + 1 : last], ' ') as content from chunk join pre using (doc_id))
select doc_id, k as chunk_index, length(content) // 4 as token_count,
  coalesce(sum(length(content) - 200) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as approx_start,
  coalesce(sum(length(content) - 200) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint + length(content) as approx_end
from c""")
def simple_chunk(spark, sf_dir):
    return ch.simple_chunk(table(spark, sf_dir, "documents"), size=256, overlap=50).select(
        "doc_id", "chunk_index", "token_count", "approx_start", "approx_end"
    )


# Sections are lines here; sections over 64 tokens become parents with overlapping children.
HIER_SQL = f"""lines as (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(30)), chr(30)) as l from documents),
sec as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as section, t as text from (
  select doc_id, unnest(l) as t, unnest(range(0, len(l))) as i from lines) where trim(t, E' \\t\\n') <> ''),
placed as (select doc_id * 100000 + section as sid, *, coalesce(sum(length(text)) over (partition by doc_id order by section rows between unbounded preceding and 1 preceding), 0)::bigint as pos0 from sec),
big as (select * from placed where length(text) // 4 > 64),
{pack_ctes(64, 10, 'big', 'sid')},
kid as (select sid, k, array_to_string(s[first + 1 : last], ' ') as content from chunk join pre using (sid)),
rows_ as (
  select doc_id, section, -2 as k, 1 as level, text as content, pos0 as approx_start, pos0 + length(text) as approx_end from placed where length(text) // 4 <= 64
  union all select doc_id, section, -1, 0, text[:512], pos0, pos0 + length(text[:512]) from big
  union all select doc_id, section, kid.k, 1, kid.content,
     pos0 + coalesce(sum(length(kid.content) - 40) over (partition by sid order by kid.k rows between unbounded preceding and 1 preceding), 0)::bigint,
     pos0 + coalesce(sum(length(kid.content) - 40) over (partition by sid order by kid.k rows between unbounded preceding and 1 preceding), 0)::bigint + length(kid.content)
  from kid join big using (sid)),
hier as (select *, row_number() over (partition by doc_id order by section, k) - 1 as chunk_index, {strip_sql('content')} as body from rows_),
named as (select sha256(doc_id || ':' || section || ':' || k)[:16] as chunk_id, doc_id as source_id, chunk_index,
   case when k >= 0 then sha256(doc_id || ':' || section || ':-1')[:16] end as parent_chunk_id, level, body as content, length(body) // 4 as token_count, approx_start, approx_end from hier)"""


def hierarchy(spark, sf_dir):
    return ch.hierarchical_chunk(table(spark, sf_dir, "documents"), size=64, overlap=10, separators=("\n",))


@query("hierarchical_chunk", f"with recursive {HIER_SQL} select * replace (md5(content) as content) from named")
def hierarchical_chunk(spark, sf_dir):
    return hierarchy(spark, sf_dir).withColumn("content", F.md5("content"))


@query("merge_small", f"""with recursive s as (select doc_id, {SENT_SQL} as s from documents),
t as materialized (select doc_id, unnest(s) as part, unnest(range(1, len(s) + 1)) as i from s),
walk as (
  select doc_id, 1::bigint as i, part as open, null::varchar as done from t where i = 1
  union all
  select w.doc_id, t.i, case when length(open) // 4 < 40 then open || ' ' || part else part end, case when length(open) // 4 < 40 then null else open end
  from walk w join t on t.doc_id = w.doc_id and t.i = w.i + 1),
pieces as (select doc_id, i, done as piece from walk where done is not null
  union all select doc_id, max(i) + 1, arg_max(open, i) from walk group by 1)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, md5(piece) as piece from pieces""")
def merge_small(spark, sf_dir):
    split = dm.with_sentences(table(spark, sf_dir, "documents"))
    return unfold(split, ["doc_id"], ch.merge_small("sentences", 40), "piece", "pos").withColumn("piece", F.md5("piece"))


@query("chunk_links", f"""with recursive {HIER_SQL} select parent_chunk_id as chunk_id, string_agg(chunk_id, '|' order by chunk_index) as children
from named where parent_chunk_id is not null group by 1""")
def chunk_links(spark, sf_dir):
    return ch.chunk_links(hierarchy(spark, sf_dir)).select("chunk_id", F.array_join("children_ids", "|").alias("children"))


@query("chunk_tree", f"""with recursive {HIER_SQL}
select r.source_id, r.chunk_id, r.chunk_index, r.token_count, string_agg(c.chunk_index || ':' || c.token_count, '|' order by c.chunk_index) as children
from named r left join named c on c.parent_chunk_id = r.chunk_id where r.level = 0 group by 1, 2, 3, 4""")
def chunk_tree(spark, sf_dir):
    return ch.chunk_tree(hierarchy(spark, sf_dir)).select(
        "source_id", "chunk_id", "chunk_index", "token_count",
        F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["chunk_index"].cast("string"), c["token_count"].cast("string"))), "|").alias("children"),
    )


@query("chunk_hierarchy", f"""with recursive {HIER_SQL} select source_id, count(*) as total_chunks, count(*) filter (level = 0) as parent_count,
  count(*) filter (level > 0) as child_count, count(*) filter (level = 0 and parent_chunk_id is null) as root_count from named group by 1""")
def chunk_hierarchy(spark, sf_dir):
    return ch.chunk_hierarchy(hierarchy(spark, sf_dir))


@query("chunk_edges", f"""with recursive {HIER_SQL}
select 'belongs_to' as edge_type, chunk_id as src, source_id::varchar as dst, 1.0::double as weight, 1.0::double as confidence from named
union all select 'parent_of', parent_chunk_id, chunk_id, 1.0, 1.0 from named where parent_chunk_id is not null""")
def chunk_edges(spark, sf_dir):
    return ch.chunk_edges(hierarchy(spark, sf_dir))


@query("chunk_report", f"""with recursive {HIER_SQL},
probe as (select chunk_id, source_id, token_count, level, case when chunk_index % 5 = 0 and level = 0 then 'x' else parent_chunk_id end as parent_chunk_id, content from named)
select chunk_id, source_id, token_count, problem from (
  select *, unnest(list_filter([case when token_count < 10 then 'too_short' end, case when token_count > 96 then 'too_long' end,
    case when parent_chunk_id is not null and level = 0 then 'parent_on_level_0' end], lambda x: x is not null)) as problem from probe where content <> '')""")
def chunk_report(spark, sf_dir):
    planted = hierarchy(spark, sf_dir).withColumn(
        "parent_chunk_id", F.when((F.col("chunk_index") % 5 == 0) & (F.col("level") == 0), "x").otherwise(F.col("parent_chunk_id"))
    )
    return ch.validate_chunks(planted, 32)
