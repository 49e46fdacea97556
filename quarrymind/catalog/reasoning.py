"""Mode detection, answer scoring, extraction and table-upkeep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymind.catalog.common import EDGES_SQL, NODES_SQL, NOT_WORD, edges, nodes, r6, sql_list, table, with_ctes
from quarrymind.operators import answers as an
from quarrymind.operators import extraction as ex
from quarrymind.operators import routing as rt
from quarrymind.operators import tables as tb

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- modes

# Requests put before the words of a turn, so that every rule is met by some query.
ASKS = [
    "", "dame ejercicios de", "lista de problemas sobre", "¿cómo se resuelve", "paso a paso:", "qué es", "define", "explica la teoría de",
    "show me exercises on", "how do you solve", "step by step", "what is", "quiero practicar", "ejercicio", "cambiar a modo práctica",
    "switch to mode theory", "modo ejercicios por favor", "3 + 4 =", "necesito problemas para", "diferencia entre", "walk me through",
    "explícame la teoría", "como", "problem", "i want practice problems:", "solución detallada de", "muestra el procedimiento", "propiedades de",
]
ASKED_SQL = f"""asked as (
  select conv_id as session_id, turn as turn_no, ({sql_list(ASKS)})[(conv_id * 5 + turn) % {len(ASKS)} + 1] || ' '
    || array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') as text from conversations)"""


def asked(spark, sf_dir):
    from quarrymind.functions.text import words

    c, t = F.col("conv_id"), F.col("turn")
    ask = F.element_at(F.array(*[F.lit(a) for a in ASKS]), ((c * 5 + t) % len(ASKS) + 1).cast("int"))
    some = F.array_join(words("text"), " ")
    return table(spark, sf_dir, "conversations").select(
        c.alias("session_id"), t.alias("turn_no"), F.concat(ask, F.lit(" "), some).alias("text")
    )


def _re2(pattern: str) -> str:
    """The pattern with word edges that respect accented letters."""
    edge_start, edge_end = r"(?:^|[^\p{L}\p{M}\p{Nd}_])", r"(?:$|[^\p{L}\p{M}\p{Nd}_])"
    if pattern.startswith(r"\b"):
        pattern = edge_start + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + edge_end
    return quoted("(?i)" + pattern)


def any_sql(x: str, marks: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {quoted(m)})" for m in marks) + ")" if marks else "false"


def _score_sql(mode: str) -> str:
    patterns, words_ = rt.MARKS[mode]
    n = " + ".join(f"regexp_matches(q, {_re2(p)})::int" for p in patterns)
    k = " + ".join(f"contains(q, {quoted(w)})::int" for w in words_) or "0"
    return f"least(1.0, ({n}) * 0.4 + ({k}) * 0.3)::double"


MODE_SQL = ASKED_SQL + f""",
low as (select *, lower(trim(text)) as q from asked),
base as (select *, {_score_sql('concept')} as c0, {_score_sql('practice')} as p0, {_score_sql('exercise_list')} as e0 from low),
adj as (select *,
   c0 + case when regexp_matches(q, '(qué|que)\\s+(es|son|significa)|define|definición') then 0.3 else 0 end as c1,
   p0 + case when regexp_matches(q, '\\d+|\\+|\\-|\\*|\\/|=') then 0.15 else 0 end as p1,
   e0 + case when len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) <= 5 and {any_sql('q', ['ejercicio', 'problema', 'práctica'])} then 0.2 else 0 end as e1
  from base)"""


def _pick_sql(c: str, p: str, e: str) -> str:
    return f"""case when {e} >= 0.5 then 'exercise_list' when {p} >= 0.5 then 'practice' when {c} >= 0.3 then 'concept'
   when {any_sql('q', ['ejercicio', 'problema', 'práctica', 'exercise', 'problem'])} then
     case when {any_sql('q', ['cómo', 'como', 'resolver', 'resuelve', 'solve', 'how'])} then 'practice' else 'exercise_list' end
   when {any_sql('q', ['cómo', 'como', 'how'])} then 'practice' else 'concept' end"""


def _capped(x: str, prev: str | None = None, mode: str = "") -> str:
    bonus = f" + case when {prev} = '{mode}' then 0.1 else 0 end" if prev else ""
    return f"round(least(1.0, {x}{bonus}), 9)"


CLASSIFIED_SQL = MODE_SQL + f""",
capped as (select *, {_capped('c1')} as c, {_capped('p1')} as p, {_capped('e1')} as e from adj),
moded as (select *, {_pick_sql('c', 'p', 'e')} as mode from capped),
classified as (select *, case mode when 'concept' then c when 'practice' then p else e end as own,
  case mode when 'concept' then greatest(p, e) when 'practice' then greatest(c, e) else greatest(c, p) end as other from moded)"""


@query("classify_mode", f"with {CLASSIFIED_SQL}" + """
select session_id, turn_no, mode, round(c, 6) as concept_score, round(p, 6) as practice_score, round(e, 6) as exercise_list_score,
       round(case when own > 0 then least(1.0, own - other + 0.5) else 0.5 end, 6) as confidence from classified""")
def classify_mode(spark, sf_dir):
    return rt.classify_mode(asked(spark, sf_dir)).select(
        "session_id", "turn_no", "mode", r6("concept_score"), r6("practice_score"), r6("exercise_list_score"), r6("confidence")
    )


def _list_sql(mode: str) -> str:
    patterns, words_ = rt.MARKS[mode]
    found = [f"case when regexp_matches(q, {_re2(p)}) then {quoted(f'pattern:{p[:30]}...')} end" for p in patterns]
    found += [f"case when contains(q, {quoted(w)}) then {quoted('keyword:' + w)} end" for w in words_]
    return f"list_filter([{', '.join(found)}], lambda m: m is not null)"


@query("mode_reasons", f"""with {CLASSIFIED_SQL},
l as (select *, case mode when 'concept' then {_list_sql('concept')} when 'practice' then {_list_sql('practice')} else {_list_sql('exercise_list')} end as m from classified)
select session_id, turn_no, array_to_string(m, '|') as matched_patterns, case when len(m) = 0 then 'Default mode (' || mode || ') - no strong patterns detected'
  else 'Detected ' || mode || ' (score=' || format('{{:.2f}}', own) || '): ' || array_to_string(m[1:3], ', ') || case when len(m) > 3 then ' (+' || (len(m) - 3) || ' more)' else '' end end as reason from l""")
def mode_reasons(spark, sf_dir):
    return rt.classify_mode(asked(spark, sf_dir)).select(
        "session_id", "turn_no", F.array_join("matched_patterns", "|").alias("matched_patterns"), "reason"
    )


@query("previous_mode", f"""with recursive {MODE_SQL},
num as materialized (select *, row_number() over (partition by session_id order by turn_no) as i from adj),
walk as (
  select session_id, i, turn_no, null::varchar as previous_mode, {_pick_sql(_capped('c1'), _capped('p1'), _capped('e1'))} as mode from num where i = 1
  union all
  select n.session_id, n.i, n.turn_no, w.mode, {_pick_sql(_capped('c1', 'w.mode', 'concept'), _capped('p1', 'w.mode', 'practice'), _capped('e1', 'w.mode', 'exercise_list'))}
  from walk w join num n on n.session_id = w.session_id and n.i = w.i + 1)
select session_id, turn_no, previous_mode, mode from walk""")
def previous_mode(spark, sf_dir):
    carried = rt.with_previous_mode(asked(spark, sf_dir), block=3)
    return rt.classify_mode(carried).select("session_id", "turn_no", "previous_mode", "mode")


SWITCH_SQL = f"""case when {any_sql('lower(text)', rt.SWITCH_PHRASES)} then case when {any_sql('lower(text)', rt.SWITCH_WORDS['concept'])} then 'concept'
   when {any_sql('lower(text)', rt.SWITCH_WORDS['practice'])} then 'practice' when {any_sql('lower(text)', rt.SWITCH_WORDS['exercise_list'])} then 'exercise_list' end end"""


@query("mode_switch", f"with {ASKED_SQL} select session_id, turn_no, {SWITCH_SQL} as switch_mode from asked")
def mode_switch(spark, sf_dir):
    return rt.mode_switch(asked(spark, sf_dir)).select("session_id", "turn_no", "switch_mode")


@query("effective_mode", f"""with {CLASSIFIED_SQL}
select session_id, turn_no, coalesce(case when turn_no % 5 = 4 then 'practice' end, {SWITCH_SQL}, mode) as mode,
  round(case when turn_no % 5 = 4 or {SWITCH_SQL} is not null then 1.0 when own > 0 then least(1.0, own - other + 0.5) else 0.5 end, 6) as confidence from classified""")
def effective_mode(spark, sf_dir):
    forced = asked(spark, sf_dir).withColumn("forced_mode", F.when(F.col("turn_no") % 5 == 4, "practice"))
    return rt.effective_mode(forced).select("session_id", "turn_no", "mode", r6("confidence"))


# Stocks per tenant from the documents: tenants are languages, and some of two tenants' stocks count as definitions.
STOCK_SQL = """stock as (select lang as tenant, (['exercise', 'worked_example', 'concept', 'definition', 'chunk'])[doc_id % 5 + 1] as content_type, count(*) as n
  from (select lang, case when lang = 'de' and doc_id % 5 = 4 or lang = 'fr' and doc_id % 5 < 2 then 3 else doc_id end as doc_id from documents) group by 1, 2),
wanted as (select doc_id, lang as tenant, (['concept', 'practice', 'exercise_list'])[doc_id % 3 + 1] as mode from documents)"""


@query("mode_feasible", f"with {STOCK_SQL}" + """,
h as (select tenant, coalesce(sum(n) filter (content_type = 'exercise'), 0)::bigint as e, coalesce(sum(n) filter (content_type = 'worked_example'), 0)::bigint as w,
  coalesce(sum(n) filter (content_type = 'concept'), 0)::bigint as c, coalesce(sum(n) filter (content_type = 'definition'), 0)::bigint as d,
  coalesce(sum(n) filter (content_type = 'chunk'), 0)::bigint as k from stock group by 1)
select doc_id, mode, case mode when 'exercise_list' then e > 0 when 'practice' then w > 0 or e > 0 else k > 0 end as feasible,
  case mode when 'exercise_list' then case when e > 0 then e || ' ejercicios disponibles' else 'No hay ejercicios disponibles en los documentos cargados' end
    when 'practice' then case when w > 0 or e > 0 then w || ' ejemplos resueltos, ' || e || ' ejercicios' else 'No hay ejemplos resueltos o ejercicios disponibles' end
    else case when k > 0 then c || ' conceptos, ' || d || ' definiciones' else 'No hay contenido conceptual disponible' end end as message
from wanted join h using (tenant)""")
def mode_feasible(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("exercise", "worked_example", "concept", "definition", "chunk")])
    bare = ((F.col("lang") == "de") & (i % 5 == 4)) | ((F.col("lang") == "fr") & (i % 5 < 2))
    kind = F.element_at(kinds, (F.when(bare, F.lit(3)).otherwise(i) % 5 + 1).cast("int"))
    stock = d.groupBy(F.col("lang").alias("tenant"), kind.alias("content_type")).agg(F.count("*").alias("n"))
    modes = F.array(*[F.lit(m) for m in rt.MODES])
    wanted = d.select("doc_id", F.col("lang").alias("tenant"), F.element_at(modes, (i % 3 + 1).cast("int")).alias("mode"))
    return rt.mode_feasible(wanted, stock).select("doc_id", "mode", "feasible", "message")


@query("strategies", f"with {CLASSIFIED_SQL}" + """,
s as (select *, case mode when 'practice' then 'worked_example' when 'exercise_list' then 'exercise' end as chunk_type_filter,
  case mode when 'exercise_list' then 20 else 10 end as k, case mode when 'exercise_list' then 0.1 else 0.3 end as m,
  case mode when 'concept' then 0.35 when 'practice' then 0.45 else 0.0 end as vw, case mode when 'concept' then 0.25 when 'practice' then 0.15 else 0.0 end as bw,
  case mode when 'exercise_list' then 1.0 else 0.4 end as gw, turn_no % 2 = 1 as more from classified)
select session_id, turn_no, mode, chunk_type_filter, case when more then least(30, k + 5) else k end as top_k,
  round(case when more then greatest(0.1, m - 0.1) else m end, 6) as min_score, vw::double as vector_weight, bw::double as bm25_weight, gw::double as graph_weight,
  case mode when 'exercise_list' then 'metadata_only' else 'graph_enhanced' end as strategy from s""")
def strategies(spark, sf_dir):
    moded = rt.classify_mode(asked(spark, sf_dir)).withColumn("more_context", F.col("turn_no") % 2 == 1)
    return rt.expand_strategy(rt.strategy_for(moded)).select(
        "session_id", "turn_no", "mode", "chunk_type_filter", "top_k", r6("min_score"), "vector_weight", "bm25_weight", "graph_weight", "strategy"
    )


@query("strategies_basic", f"with {CLASSIFIED_SQL}" + """
select session_id, turn_no, case mode when 'concept' then 'graph_enhanced' when 'practice' then 'hybrid' else 'metadata_only' end as strategy,
  case mode when 'concept' then 0.35 when 'practice' then 0.4 else 0.5 end::double as vector_weight from classified""")
def strategies_basic(spark, sf_dir):
    return rt.strategy_for(rt.classify_mode(asked(spark, sf_dir)), "basic").select("session_id", "turn_no", "strategy", "vector_weight")


# ---------------------------------------------------------------- answers

# Replies to the turn before, some given a wording that the rules look for.
WORDINGS = [
    "", "La definición significa que", "Paso 1) primero. El resultado es 4 porque", "1. ejercicio uno\n2. ejercicio dos\n- dificultad",
    "Para resolver, primero aplicamos el método, entonces", "• problema, nivel medio\n\n", "Es decir, esto significa que", "1) dado x\n2) por lo tanto la solución es =",
]
REPLY_SQL = f"""reply as (
  select a.conv_id * 100 + a.turn as query_id, a.text as query, (['concept', 'practice', 'exercise_list'])[(a.conv_id + a.turn) % 3 + 1] as mode,
     replace(({sql_list([w.replace(chr(10), '~') for w in WORDINGS])})[(a.conv_id * 3 + a.turn) % {len(WORDINGS)} + 1], '~', chr(10)) || ' ' || b.text as answer
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
ctx as (
  select a.conv_id * 100 + a.turn as query_id, c.turn + 1 as rank, c.text as content, list_distinct(string_split_regex(lower(c.text), '\\s+'))[1:0] as none,
     (list_filter(string_split_regex(c.text, '\\s+'), lambda w: w <> ''))[1:3] as concepts
  from conversations a join conversations c on c.conv_id = a.conv_id and c.turn < a.turn where a.turn > 0)"""


def reply(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    word = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), ((F.col("conv_id") * 3 + F.col("turn")) % len(WORDINGS) + 1).cast("int"))
    mode = F.element_at(F.array(*[F.lit(m) for m in rt.MODES]), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    return c.join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), mode.alias("mode"),
        F.concat(word, F.lit(" "), F.col("reply")).alias("answer"),
    )


def contexts(spark, sf_dir):
    """A reply draws on the earlier turns of its conversation, which has at most eight."""
    from quarrymind.functions.text import words

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + 8))
    return c.select("conv_id", "turn", "text", later.alias("asked_at")).join(
        c.select("conv_id", F.col("turn").alias("asked_at")), ["conv_id", "asked_at"], "left_semi"
    ).select(
        (F.col("conv_id") * 100 + F.col("asked_at")).alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("content"),
        F.slice(words("text"), 1, 3).alias("concepts"),
    )


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


SCORES_SQL = REPLY_SQL + f""",
cc as (select x.query_id, count(distinct c) as nc, count(distinct c) filter (contains(lower(r.answer), c)) as mc
  from (select query_id, lower(unnest(concepts)) as c from ctx) x join reply r using (query_id) group by 1),
cu as (select query_id, count(*) as n, count(*) filter (rank <= 5 and len(list_intersect(list_distinct({_words('lower(content)')}), list_distinct({_words('lower(answer)')}))) > 3) as u
  from ctx join reply using (query_id) group by 1),
f as (select r.*, len({_words('answer')}) as n, lower(answer) as low, coalesce(0.5 * coalesce(mc, 0) / greatest(coalesce(nc, 0), 1) + 0.5 * u / least(cu.n, 5), 0.5) as context_coverage
  from reply r left join cu using (query_id) left join cc using (query_id)),
g as (select *,
  case mode when 'concept' then case when {any_sql('low', an.DEFINITION_MARKS)} then 0.5 else 0 end + case when n > 50 then 0.5 else 0 end
    when 'practice' then case when regexp_matches(low, '(paso|step|\\d+[\\.\\)])') then 0.6 else 0 end + case when {any_sql('low', an.RESULT_MARKS)} then 0.4 else 0 end
    else greatest(0, least(1, case when regexp_matches(answer, '(\\d+[\\.\\)]\\s|\\-\\s|•)') then 0.4 else 0 end + case when {any_sql('low', an.EXERCISE_MARKS)} then 0.3 else 0 end
      + case when n < 300 then 0.3 else -0.3 end)) end as mode_alignment,
  least(1.0, n / 50) * 0.4 + len(list_intersect(list_distinct({_words('lower(query)')}), list_distinct({_words('low')}))) / greatest(len(list_distinct({_words('lower(query)')})), 1) * 0.6 as content_quality,
  case mode when 'exercise_list' then case when regexp_matches(answer, '(\\d+[\\.\\)]\\s.+\\n?){{2,}}') then 0.8 else 0.4 end
    when 'practice' then case when regexp_matches(answer, '(\\d+[\\.\\)]\\s.+\\n?){{2,}}') then 0.9 else 0.5 end
    else case when regexp_matches(answer, '\\d+[\\.\\)]') or regexp_matches(answer, '[\\-\\*•]') or contains(answer, chr(10) || chr(10)) then 0.7 else 0.5 end end as format_compliance,
  case when mode = 'exercise_list' then {' + '.join(f"contains(low, {quoted(m)})::int" for m in an.EXPLANATION_MARKS)} + (n > 200)::int else 0 end as violations from f),
sc as (select *, greatest(0, 1 - violations * 0.2) as prohibition_check from g),
scored as (select *, round(mode_alignment * 0.35 + prohibition_check * 0.25 + content_quality * 0.2 + context_coverage * 0.1 + format_compliance * 0.1, 9) as overall_score,
  round(mode_alignment, 9) >= 0.5 and (mode <> 'exercise_list' or n < 300) as mode_passed, violations < 3 as prohibitions_passed from sc)"""


@query("score_answers", f"with {SCORES_SQL}" + """
select query_id, mode, round(mode_alignment, 6) as mode_alignment, round(content_quality, 6) as content_quality, round(context_coverage, 6) as context_coverage,
  round(format_compliance, 6) as format_compliance, round(prohibition_check, 6) as prohibition_check, round(overall_score, 6) as overall_score,
  mode_passed and prohibitions_passed as mode_aligned from scored""")
def score_answers(spark, sf_dir):
    return an.score_answers(reply(spark, sf_dir), contexts(spark, sf_dir)).select(
        "query_id", "mode", r6("mode_alignment"), r6("content_quality"), r6("context_coverage"), r6("format_compliance"),
        r6("prohibition_check"), r6("overall_score"), "mode_aligned",
    )


DECIDE_SQL = SCORES_SQL + """,
st as (select *, query_id % 5 as retries, query_id % 5 < 3 as can, case when not prohibitions_passed and mode = 'exercise_list' then 'forbidden' when not mode_passed then 'mismatch'
  when context_coverage < 0.2 and query_id % 5 < 3 then 'thin' when overall_score >= 0.6 then 'good' when query_id % 5 < 3 then 'low' else 'spent' end as stage from scored),
decided as (select *, case stage when 'forbidden' then case when can then 'retry' else 'fallback' end when 'mismatch' then case when can then 'mode_mismatch' else 'fallback' end
  when 'thin' then 'request_more_context' when 'good' then 'accept' when 'low' then 'retry' else 'fallback' end as decision from st)"""


@query("decide", f"with {DECIDE_SQL}" + """
select query_id, decision, case stage when 'forbidden' then case when can then 'Violación de prohibiciones en EXERCISE_LIST' else 'Max retries alcanzado con violaciones' end
  when 'mismatch' then case when can then 'Modo esperado: ' || mode else 'Max retries con mode mismatch' end when 'thin' then 'Necesita más contexto'
  when 'good' then 'Score aceptable: ' || format('{:.2f}', overall_score) when 'low' then 'Score bajo: ' || format('{:.2f}', overall_score) else 'Máximo de reintentos alcanzado' end as decision_reason,
  stage not in ('forbidden', 'mismatch') and context_coverage < 0.2 as expand_context, stage in ('forbidden', 'low') as decrease_temperature,
  case when stage = 'mismatch' and mode <> 'concept' then mode end as suggested_mode, can and decision in ('retry', 'mode_mismatch', 'request_more_context') as should_retry from decided""")
def decide(spark, sf_dir):
    scored = an.score_answers(reply(spark, sf_dir), contexts(spark, sf_dir)).withColumn("retries", F.col("query_id") % 5)
    return an.decide(scored).select(
        "query_id", "decision", "decision_reason", "expand_context", "decrease_temperature", "suggested_mode", "should_retry"
    )


def _spec_sql() -> tuple[str, str]:
    score, issues = "1.0", []
    for mode, (requirements, prohibitions) in an.SPECS.items():
        total = sum(r[3] for r in requirements if r[2])
        for name, _, required, weight, marks in requirements:
            if required:
                miss = f"mode = '{mode}' and not {any_sql('low', marks)}"
                score += f" - case when {miss} then {weight / total * 0.4!r} else 0 end"
                issues.append(f"case when {miss} then {quoted('Falta: ' + name)} end")
        for name, _, penalty, marks in prohibitions:
            hit = f"mode = '{mode}' and {any_sql('low', marks)}"
            score += f" - case when {hit} then {penalty} else 0 end"
            issues.append(f"case when {hit} then {quoted('Prohibido: ' + name)} end")
    return score, f"concat_ws('|', {', '.join(issues)})"


_SPEC_SCORE, _SPEC_ISSUES = _spec_sql()


@query("validate_answers", f"""with {REPLY_SQL}, l as (select *, lower(answer) as low from reply)
select query_id, mode, round(greatest(0, least(1, {_SPEC_SCORE})), 6) as spec_score, {_SPEC_ISSUES} as issues from l""")
def validate_answers(spark, sf_dir):
    return an.validate_answers(reply(spark, sf_dir)).select("query_id", "mode", r6("spec_score"), F.array_join("issues", "|").alias("issues"))


@query("weighted_quality", f"""with {SCORES_SQL}
select query_id, round(case mode when 'concept' then content_quality * 0.3 + context_coverage * 0.25 + format_compliance * 0.15 + prohibition_check * 0.15 + mode_alignment * 0.15
  when 'practice' then content_quality * 0.25 + context_coverage * 0.2 + format_compliance * 0.2 + prohibition_check * 0.15 + mode_alignment * 0.2
  else content_quality * 0.2 + context_coverage * 0.15 + format_compliance * 0.15 + prohibition_check * 0.1 + mode_alignment * 0.4 end, 6) as weighted_quality from scored""")
def weighted_quality(spark, sf_dir):
    scored = an.score_answers(reply(spark, sf_dir), contexts(spark, sf_dir))
    named = scored.withColumnsRenamed({
        "content_quality": "relevance", "context_coverage": "coverage", "format_compliance": "coherence", "prohibition_check": "completeness"
    })
    return an.weighted_quality(named).select("query_id", r6("weighted_quality"))


@query("qa_report", f"with {DECIDE_SQL}" + """
select mode, decision as final_decision, count(*) as answers, round(avg(retries + 1), 6) as avg_iterations,
  count(*) filter (decision = 'mode_mismatch') as mode_changes, count(*) filter (decision = 'request_more_context') as retrieval_expansions from decided group by 1, 2""")
def qa_report(spark, sf_dir):
    scored = an.score_answers(reply(spark, sf_dir), contexts(spark, sf_dir)).withColumn("retries", F.col("query_id") % 5)
    log = an.decide(scored).select(
        "mode", F.col("decision").alias("final_decision"), (F.col("retries") + 1).alias("iterations"),
        (F.col("decision") == "mode_mismatch").cast("long").alias("mode_changes"),
        (F.col("decision") == "request_more_context").cast("long").alias("retrieval_expansions"),
    )
    return an.qa_report(log).withColumn("avg_iterations", F.round("avg_iterations", 6))


# ---------------------------------------------------------------- extraction

# Model responses made from the words of each document (%1 to %5 its first ones, %6 all), in five shapes: clean, inside
# prose, with single quotes, with trailing commas, and unreadable.
_JSON = {
    "concepts": """[{"name": "%1", "description": "%6", "difficulty": 2}, {"name": "%2", "importance": 0.9, "aliases": ["%4"]}, {"name": "%5"}, {"name": "%3", "description": "%1"}]""",
    "resolution": """{"duplicates": [{"canonical": "%1", "aliases": ["%5", "%4"]}]}""",
    "definitions": """[{"concept": "%1", "definition": "%6"}, {"concept": "%2", "definition": "x", "confidence": 0.6}, {"concept": "nobody", "definition": "y"}]""",
    "relationships": """[{"from": "%1", "to": "%2", "type": "prerequisite"}, {"from": "%2", "to": "%3", "type": "contrasts", "confidence": 0.9}, {"from": "%1", "to": "%3", "type": "likes"}, {"from": "%1", "to": "nobody", "type": "relates_to"}]""",
    "summary": "%6",
}


def _filled(template: str) -> str:
    out = quoted(template)
    for i in range(1, 6):
        out = f"replace({out}, '%{i}', coalesce(w[{i}], 'w{i}'))"
    return f"replace({out}, '%6', array_to_string(w, ' '))"


def _shaped(x: str) -> str:
    return f"""case doc_id % 5 when 0 then {x} when 1 then 'Here it is: ' || {x} || ' Done.' when 2 then replace({x}, '"', chr(39))
   when 3 then replace(replace({x}, '}}]', '}}, ]'), '"}}', '", }}') else 'nothing found' end"""


RESPONSES_SQL = f"""wordy as (select doc_id, (list_filter(string_split_regex(text, '{NOT_WORD}+'), lambda x: x <> '')) as w from documents),
responses as (""" + "\nunion all ".join(
    f"select doc_id as source_id, '{kind}' as kind, {_shaped(_filled(t)) if kind != 'summary' else _filled(t)} as response from wordy" for kind, t in _JSON.items()
) + ")"
READ_SQL = r"""inner_ as (select *, regexp_extract(response, '(?s)([\[{].*[\]}])', 1) as j from responses),
fixed as (select *, regexp_replace(replace(j, chr(39), '"'), ',\s*([}\]])', '\1', 'g') as f from inner_),
readable as (select source_id, kind, case when j <> '' and json_valid(j) then j when f <> '' and json_valid(f) then f end as json, response from fixed)"""


def responses(spark, sf_dir):
    w = F.filter(F.split("text", r"(?U)\W+"), lambda x: x != "")
    wordy = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    shape = F.col("doc_id") % 5
    out = None
    for kind, template in _JSON.items():
        x = F.lit(template)
        for i in range(1, 6):
            x = F.replace(x, F.lit(f"%{i}"), F.coalesce(F.get("w", F.lit(i - 1)), F.lit(f"w{i}")))
        x = F.replace(x, F.lit("%6"), F.array_join("w", " "))
        shaped = x if kind == "summary" else (
            F.when(shape == 0, x).when(shape == 1, F.concat(F.lit("Here it is: "), x, F.lit(" Done.")))
            .when(shape == 2, F.replace(x, F.lit('"'), F.lit("'")))
            .when(shape == 3, F.replace(F.replace(x, F.lit("}]"), F.lit("}, ]")), F.lit('"}'), F.lit('", }')))
            .otherwise("nothing found")
        )
        rows = wordy.select(F.col("doc_id").alias("source_id"), F.lit(kind).alias("kind"), shaped.alias("response"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _items(kind: str) -> str:
    return f"""select source_id, unnest(from_json(json, '["json"]')) as o, unnest(range(0, json_array_length(json)::bigint)) as pos
  from readable where kind = '{kind}' and json like '[%'"""


CONCEPTS_SQL = RESPONSES_SQL + ",\n" + READ_SQL + f""",
raw_c as (select source_id, pos, coalesce(o->>'name', '') as name, coalesce(o->>'description', '') as description,
   coalesce(from_json(o->'aliases', '["varchar"]'), []) as aliases, coalesce((o->>'difficulty')::int, 1) as difficulty_level,
   coalesce((o->>'importance')::double, 0.5) as importance_score from ({_items('concepts')})),
am as (select source_id, lower(a) as alias, canonical from (select source_id, d->>'canonical' as canonical, unnest(from_json(d->'aliases', '["varchar"]')) as a
   from (select source_id, unnest(from_json(json->'duplicates', '["json"]')) as d from readable where kind = 'resolution' and json like '{{%'))),
am1 as (select source_id, alias, any_value(canonical) as canonical from am group by 1, 2),
ren as (select c.*, coalesce(m.canonical, c.name) as new_name from raw_c c left join am1 m on m.source_id = c.source_id and m.alias = lower(c.name)),
res as (select source_id, pos, new_name as name, description, case when lower(name) <> lower(new_name) then list_append(aliases, name) else aliases end as aliases,
   difficulty_level, importance_score, 'concept:' || sha256(source_id || '|' || lower(new_name))[1:16] as concept_id from ren
   qualify row_number() over (partition by source_id, lower(new_name) order by pos) = 1)"""


@query("parse_responses", f"with {CONCEPTS_SQL} select source_id, pos, name, description, array_to_string(aliases, '|') as aliases, difficulty_level, importance_score from raw_c")
def parse_responses(spark, sf_dir):
    return ex.concepts_from(responses(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


def _resolved(spark, sf_dir):
    rows = responses(spark, sf_dir)
    return ex.resolve_entities(ex.concepts_from(rows), ex.alias_map(rows))


@query("resolve_entities", f"with {CONCEPTS_SQL} select concept_id, source_id, pos, name, array_to_string(aliases, '|') as aliases from res")
def resolve_entities(spark, sf_dir):
    return _resolved(spark, sf_dir).select("concept_id", "source_id", "pos", "name", F.array_join("aliases", "|").alias("aliases"))


DEFS_SQL = CONCEPTS_SQL + f""",
defs as (select r.concept_id, d.source_id, coalesce(o->>'definition', '') as text, coalesce((o->>'confidence')::double, 0.8) as confidence
  from ({_items('definitions')}) d join res r on r.source_id = d.source_id and lower(r.name) = lower(o->>'concept') and r.name <> ''),
rels as (select o->>'type' as edge_type, a.concept_id as src, b.concept_id as dst, coalesce((o->>'confidence')::double, 0.7) as confidence, d.source_id
  from ({_items('relationships')}) d join res a on a.source_id = d.source_id and lower(a.name) = lower(o->>'from') and a.name <> ''
  join res b on b.source_id = d.source_id and lower(b.name) = lower(o->>'to') and b.name <> ''
  where o->>'type' in ('prerequisite', 'relates_to', 'similar_to', 'contrasts'))"""


@query("definitions", f"with {DEFS_SQL} select source_id, concept_id, text, confidence from defs")
def definitions(spark, sf_dir):
    return ex.definitions_from(responses(spark, sf_dir), _resolved(spark, sf_dir)).drop("definition_id")


@query("relationships", f"with {DEFS_SQL} select edge_type, src, dst, confidence from rels")
def relationships(spark, sf_dir):
    return ex.relationships_from(responses(spark, sf_dir), _resolved(spark, sf_dir)).select("edge_type", "src", "dst", "confidence")


# The lines of a document are its chunks.
LINES_SQL = """lines as (select doc_id as source_id, unnest(string_split(text, chr(10))) as content, unnest(range(0, len(string_split(text, chr(10))))) as chunk_index from documents)"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).withColumn(
        "chunk_id", F.concat_ws("-", "source_id", "chunk_index")
    )


@query("link_evidence", f"with {CONCEPTS_SQL}, {LINES_SQL}" + """
select 'evidenced_by' as edge_type, concept_id as src, l.source_id || '-' || chunk_index as dst, 0.8::double as weight, 0.7::double as confidence
from res join lines l using (source_id) where contains(lower(content), lower(name))""")
def link_evidence(spark, sf_dir):
    return ex.link_evidence(_resolved(spark, sf_dir), lines(spark, sf_dir)).drop("negative_signals")


@query("transform_report", f"with {DEFS_SQL}" + """,
s as (select doc_id as source_id from documents), sm as (select source_id, response as t from responses where kind = 'summary')
select source_id, (select count(*) from res r where r.source_id = s.source_id) as concepts_created, (select count(*) from defs r where r.source_id = s.source_id) as definitions_created,
  (select count(*) from rels r where r.source_id = s.source_id) as relationships_created, case when length(t) > 200 then t[:200] || '...' else t end as summary from s join sm using (source_id)""")
def transform_report(spark, sf_dir):
    rows = responses(spark, sf_dir)
    concepts = _resolved(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    return ex.transform_report(sources, concepts, ex.definitions_from(rows, concepts), ex.relationships_from(rows, concepts), rows)


# ---------------------------------------------------------------- tables

@query("upsert", """select c_custkey, coalesce(p, c_acctbal) as c_acctbal, coalesce(v, 0) as version from customer left join (
  select o_custkey, arg_max(o_totalprice, o_orderkey) as p, max(o_orderkey + 1) as v from orders group by 1) on o_custkey = c_custkey
union all select o_custkey, arg_max(o_totalprice, o_orderkey), max(o_orderkey + 1) from orders where o_custkey not in (select c_custkey from customer) group by 1""")
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).cast("long").alias("version"))
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), (F.col("o_orderkey") + 1).alias("version")
    )
    return tb.upsert(base, changes, ["c_custkey"], "version")


@query("merge_update", """select c_custkey, coalesce(p, c_acctbal) as c_acctbal, coalesce(g, c_mktsegment) as c_mktsegment, c_name from customer left join (
  select o_custkey, arg_max(o_totalprice, o_orderkey) filter (o_orderstatus = 'F') as p, arg_max(o_orderpriority, o_orderkey) filter (o_orderstatus = 'O') as g
  from orders group by 1) on o_custkey = c_custkey""")
def merge_update(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("c_acctbal"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("c_mktsegment"), "o_orderkey",
    )
    return tb.merge_update(table(spark, sf_dir, "customer"), changes, ["c_custkey"], "o_orderkey").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_name"
    )


@query("delete_cascade", with_ctes(NODES_SQL, EDGES_SQL) + """,
gone as (select p_partkey as node_id from part where p_size > 40)
select 'node' as kind, node_id::varchar as item from nodes where node_id not in (select node_id from gone)
union all select 'edge', src || '-' || edge_type || '-' || dst from edges where src not in (select node_id from gone) and dst not in (select node_id from gone)""")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("node_id"))
    left_nodes, left_edges = tb.delete_nodes(nodes(spark, sf_dir), edges(spark, sf_dir), gone)
    return left_nodes.select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("item")).unionByName(
        left_edges.select(F.lit("edge").alias("kind"), F.concat_ws("-", "src", "edge_type", "dst").alias("item"))
    )


@query("delete_edges", with_ctes(EDGES_SQL) + """
select edge_type, src, dst from edges e where not (edge_type = 'prerequisite' and dst in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45))""")
def delete_edges(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(
        F.floor(F.col("l_partkey") / 2).alias("src"), F.lit("prerequisite").alias("edge_type"), F.col("l_partkey").alias("dst")
    )
    return tb.delete_edges(edges(spark, sf_dir), keys).select("edge_type", "src", "dst")


RUNS_SQL = """stored as (select 's' || p_partkey as source_id, p_name as title, p_type as source_type, p_size::bigint as chunk_count,
   case when p_partkey % 17 = 0 then null else timestamp '2024-01-01' + interval 1 hour * p_partkey end as created_at from part),
runs as (select 'r' || o_orderkey as run_id, 's' || (o_orderkey % 5000) as source_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status,
   'Completado: ' || o_orderkey || ' chunks' as message, o_orderkey % 100 as chunks_created, o_orderdate as started_at, o_orderdate + interval 5 minute as completed_at from orders)"""


def _sources_and_runs(spark, sf_dir):
    k = F.col("p_partkey")
    stored = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), k).alias("source_id"), F.col("p_name").alias("title"), F.col("p_type").alias("content_type"), F.col("p_size").alias("total_chunks"),
        F.when(k % 17 != 0, F.timestamp_seconds(F.lit(1704067200) + k * 3600)).alias("created_at"),
    )
    o, state = F.col("o_orderkey"), F.col("o_orderstatus")
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), o).alias("run_id"), F.concat(F.lit("s"), o % 5000).alias("source_id"),
        F.when(state == "F", "completed").when(state == "O", "pending").otherwise("failed").alias("status"),
        F.concat(F.lit("Completado: "), o, F.lit(" chunks")).alias("message"), (o % 100).alias("chunks_created"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 5 minutes")).alias("completed_at"),
    )
    return stored, runs


@query("list_sources", with_ctes(RUNS_SQL) + """,
st as (select source_id, title, source_type, 'completed' as status, chunk_count, created_at from stored),
al as (select * from st
  union all select source_id, replace(message, 'Completado: ', ''), 'file', 'completed', chunks_created, completed_at from runs where status = 'completed' and source_id not in (select source_id from st)
  union all select run_id, message, 'file', status, 0, started_at from runs where status in ('pending', 'processing'))
select source_id, title, source_type, status, chunk_count, (select count(*) from al) as total from al order by created_at desc nulls last, source_id limit 100""")
def list_sources(spark, sf_dir):
    return tb.list_sources(*_sources_and_runs(spark, sf_dir)).drop("created_at")


@query("list_runs", with_ctes(RUNS_SQL) + "select run_id, status, message from runs where status = 'pending' order by started_at desc, run_id limit 50")
def list_runs(spark, sf_dir):
    return tb.list_runs(_sources_and_runs(spark, sf_dir)[1], "pending").select("run_id", "status", "message")


@query("run_counts", with_ctes(RUNS_SQL) + "select status, count(*) as runs from runs group by 1")
def run_counts(spark, sf_dir):
    return tb.run_counts(_sources_and_runs(spark, sf_dir)[1])


_MODEL_ROWS = ", ".join(f"('{m}', '{p}', {w}, {o}, {d})" for m, p, w, o, d in tb.MODELS)


@query("token_budget", f"""with m(model, provider, cw, mo, dm) as (values {_MODEL_ROWS}),
rq as (select o_orderkey as request_id, (['gpt-4o', 'gpt-3.5-turbo', 'gemma-3-27b-it', 'unlisted'])[o_orderkey % 4 + 1] as model, (o_totalprice / 10)::bigint as input_tokens,
   (o_custkey % 3) * 3000 as output_tokens from orders)
select request_id, case when cw is null then 'unknown_model' when input_tokens + output_tokens > cw then 'exceeds_context' when output_tokens > mo then 'exceeds_output' else 'ok' end as status,
  coalesce(cw, 128000) - input_tokens - output_tokens as available,
  coalesce(cw, 128000) - case when output_tokens > 0 then output_tokens else coalesce(dm, 4096) end - floor(coalesce(cw, 128000) * 0.05)::bigint as safe_limit
from rq left join m using (model)""")
def token_budget(spark, sf_dir):
    o = F.col("o_orderkey")
    rq = table(spark, sf_dir, "orders").select(
        o.alias("request_id"), F.element_at(F.array(*[F.lit(m) for m in ("gpt-4o", "gpt-3.5-turbo", "gemma-3-27b-it", "unlisted")]), (o % 4 + 1).cast("int")).alias("model"),
        F.bround(F.col("o_totalprice") / 10).cast("long").alias("input_tokens"), (F.col("o_custkey") % 3 * 3000).alias("output_tokens"),
    )
    return tb.check_token_budget(rq, tb.model_limits(spark)).select("request_id", "status", "available", "safe_limit")
