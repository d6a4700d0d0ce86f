"""Registered queries for the row-local path, text, signal and question columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import paths, questions, redact, signals
from srcloom.plans.ingest_queries import sensitive_sql
from srcloom.registry import query
from srcloom.sources import corpus

P = "file_path"
PL = "lower(file_path)"
KEY = ["project_id", "file_path"]

# Every page address is a path too, so the path rules see free-form input as well.
views.register(
    "v_paths",
    """SELECT doc_id AS key, file_path FROM tree_files UNION ALL SELECT -1 - page_id, url FROM pages
      UNION ALL SELECT 10000000 + doc_id, replace(file_path, '/', '\\') FROM tree_files""",
)


def _paths(spark, sf):
    tree = corpus.tree_files(spark, sf)
    pages = corpus.table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("key"), F.col("url").alias("file_path"))
    back = tree.select((F.col("doc_id") + 10000000).alias("key"), F.translate("file_path", "/", "\\").alias("file_path"))
    return tree.select(F.col("doc_id").alias("key"), "file_path").unionByName(pages).unionByName(back)


@query(
    "path_functions",
    f"""SELECT key, {q.dirname('file_path')} AS folder, {q.basename('file_path')} AS base, {q.stem('file_path')} AS stem,
      {q.ext('file_path')} AS ext, replace(file_path, '\\', '/') AS normal, len(string_split(file_path, '/')) - 1 AS depth FROM v_paths""",
)
def _(spark, sf):
    return _paths(spark, sf).select(
        "key",
        paths.dirname(P).alias("folder"),
        paths.basename(P).alias("base"),
        paths.stem(P).alias("stem"),
        paths.extname(P).alias("ext"),
        paths.normalize(P).alias("normal"),
        paths.depth(P).alias("depth"),
    )


@query("is_sensitive_path", f"SELECT key, {sensitive_sql('file_path')} AS sensitive FROM v_paths")
def _(spark, sf):
    return _paths(spark, sf).select("key", paths.is_sensitive(P).alias("sensitive"))


_FLAGS = {
    "is_test_file": (paths.is_test_file, q.m("file_path", dims.TEST_FILE)),
    "is_documentation_file": (paths.is_documentation, q.m("file_path", dims.DOC_FILE, "i")),
    "is_product_overview_doc": (paths.is_overview_doc, q.m(PL, dims.OVERVIEW_DOC)),
    "is_narrow_reference_doc": (
        paths.is_narrow_reference_doc,
        f"({q.m('file_path', dims.DOC_FILE, 'i')} AND NOT {q.m(PL, dims.OVERVIEW_DOC)} AND {q.m(PL, dims.NARROW_DOC_DIR)})",
    ),
    "is_noise_file": (paths.is_noise, q.m(PL, dims.NOISE_FILE)),
    "is_package_boundary": (paths.is_package_boundary, q.m("file_path", dims.PACKAGE_BOUNDARY)),
}


def _flag_query(name, fn, sql):
    @query(name, f"SELECT key, {sql} AS flag FROM v_paths")
    def _(spark, sf):
        return _paths(spark, sf).select("key", fn(P).alias("flag"))


for _name, (_fn, _sql) in _FLAGS.items():
    _flag_query(_name, _fn, _sql)


def buckets_sql(p: str = "file_path") -> str:
    cols = {"path_lower": f"lower({p})"}

    def labels(table):
        return q.compact([f"CASE WHEN {q.holds(cond, cols)} THEN {q.s(name)} END" for name, cond in table])

    code = labels(dims.CODE_BUCKETS)
    return (
        f"CASE WHEN {q.m(p, dims.DOC_FILE, 'i')} THEN {labels(dims.DOC_BUCKETS)} ELSE "
        f"list_filter({code}, lambda b, i: list_position({code}, b) = i) END"
    )


@query("evidence_buckets", f"SELECT key, array_to_string({buckets_sql()}, '|') AS buckets FROM v_paths")
def _(spark, sf):
    return _paths(spark, sf).select("key", F.array_join(paths.evidence_buckets(P), "|").alias("buckets"))


_EXT = f"lower({q.ext('file_path')})"


@query(
    "language_label",
    f"""SELECT key, {q.lit_map(_EXT, dims.SURVEY_LABELS, f"upper(regexp_replace({_EXT}, '^[.]', ''))")} AS label FROM v_paths""",
)
def _(spark, sf):
    return _paths(spark, sf).select("key", paths.language_label(F.lower(paths.extname(P))).alias("label"))


# --- redaction ------------------------------------------------------------------------------


def _assign_sql(mark: str, other: str, any_flags: str) -> str:
    return f"""CASE WHEN {q.m('line', dims.SECRET_ASSIGNMENT, 'i')} THEN {q.rep('line', dims.SECRET_ASSIGNMENT, chr(92) + '1' + mark, 'i')}
      WHEN {q.m(q.ex('line', dims.ANY_ASSIGNMENT, 2, any_flags), dims.SECRET_URL)} THEN {q.rep('line', dims.ANY_ASSIGNMENT, chr(92) + '1' + mark, any_flags)}
      WHEN {q.m('line', dims.SECRET_JSON, 'i')} THEN {q.rep('line', dims.SECRET_JSON, chr(92) + '1' + chr(92) + '2' + mark + chr(92) + '3', 'i')}
      WHEN {q.m(q.ex('line', dims.ANY_JSON, 3), dims.SECRET_URL)} THEN {q.rep('line', dims.ANY_JSON, chr(92) + '1' + chr(92) + '2' + mark + chr(92) + '4')}
      ELSE {other} END"""


def redact_sql(path: str, text: str) -> str:
    body = (
        f"array_to_string(list_transform(regexp_split_to_array({q.rep(text, dims.PEM_BLOCK, '[REDACTED SECRET BLOCK]')}, "
        f"'\\r?\\n'), lambda line: {_assign_sql('[REDACTED]', 'line', 'i')}), chr(10))"
    )
    strict = body
    for quote in "\"'`":
        strict = f"regexp_replace({strict}, {q.s(quote + dims.LONG_TOKEN + quote)}, {q.s(quote + '[REDACTED]' + quote)}, 'g')"
    strict = q.rep(strict, dims.SECRET_URL, "://[REDACTED]@", once=True)
    secret_path = f"({sensitive_sql(path)} OR {q.m(q.basename(path), dims.SECRET_NAME, 'i')})"
    return f"CASE WHEN {text} = '' THEN {text} WHEN {secret_path} THEN {strict} ELSE {body} END"


@query("redact_text", f"SELECT doc_id, {redact_sql('file_path', 'content')} AS redacted FROM tree_files")
def _(spark, sf):
    return corpus.tree_files(spark, sf).select("doc_id", redact.redact_text(P, F.col("content")).alias("redacted"))


_LOG_LINE = _assign_sql(
    "[redacted]",
    f"CASE WHEN {q.any_of('lower(line)', dims.LOG_MARKERS)} OR {q.m('line', dims.SECRET_URL)} THEN '[redacted]' ELSE line END",
    "",
)


@query(
    "redact_log_lines",
    f"""SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(regexp_replace({q.rep('content', dims.LOG_PEM_BLOCK, '[redacted secret block]')},
      '\\r?\\n\\z', ''), '\\r?\\n'), lambda line: {_LOG_LINE}), chr(10)) AS redacted FROM tree_files""",
)
def _(spark, sf):
    return corpus.tree_files(spark, sf).select("doc_id", redact.redact_log(F.col("content")).alias("redacted"))


# --- signals and survey scores -----------------------------------------------------------------

_ORDERED = sorted(dims.SIGNAL_RULES, key=lambda r: (-r[1], r[0]))


def _signal_sql(render) -> str:
    on = {"path": "file_path", "text": "content"}
    return q.compact([f"CASE WHEN {q.m(on[c], p, f)} THEN {render(k, s, r)} END" for k, s, r, c, p, f in _ORDERED])


views.register(
    "v_signals",
    f"""SELECT doc_id, project_id, file_path, content, bytes, {_signal_sql(lambda k, s, r: q.s(k))} AS kinds,
      {_signal_sql(lambda k, s, r: str(s))} AS scores, {_signal_sql(lambda k, s, r: q.s(r))} AS why FROM tree_files""",
)


@query(
    "source_signals",
    """SELECT doc_id, array_to_string(kinds, '|') AS kinds, coalesce(list_sum(scores), 0)::BIGINT AS total, array_to_string(why, '|') AS why FROM v_signals""",
)
def _(spark, sf):
    s = signals.source_signals(P, F.col("content"))
    return corpus.tree_files(spark, sf).withColumn("s", s).select(
        "doc_id",
        F.array_join(F.col("s.kind"), "|").alias("kinds"),
        F.aggregate("s", F.lit(0), lambda a, x: a + x["score"]).alias("total"),
        F.array_join(F.col("s.reason"), "|").alias("why"),
    )


def _reasons_sql(parts: str) -> str:
    return f"array_to_string(list_slice(list_filter(({parts}), lambda r, i: list_position(({parts}), r) = i), 1, 8), '|')"


_low = "lower(replace(file_path, '\\', '/'))"
_ecols = {"path_lower": _low, "stem": q.stem(_low)}
_e_io = "(list_contains(kinds, 'entry_point') AND list_contains(kinds, 'file_io'))"
_e_net = "(list_contains(kinds, 'entry_point') AND list_contains(kinds, 'network'))"
_big = f"bytes > {dims.MAX_FILE_BYTES}"
_e_parts = (
    q.compact(q.reasons(dims.ENTRY_RULES, _ecols) + [f"CASE WHEN {_big} THEN {q.s(dims.OVERSIZED_ENTRY[1])} END"])
    + " || why || "
    + q.compact(
        [
            f"CASE WHEN {_e_io} THEN 'entry point with file IO' END",
            f"CASE WHEN {_e_net} THEN 'entry point with network boundary' END",
        ]
    )
)
_dcols = {"path_lower": _low, "base": q.basename(_low), "is_doc": "CAST(is_doc AS VARCHAR)"}
_comment = f"(NOT is_doc AND {q.m(q.rep('content', r'^\s+', ''), dims.MODULE_COMMENT)})"
_d_parts = q.compact(
    q.reasons(dims.DOC_RULES, _dcols)
    + [
        f"CASE WHEN {_comment} THEN {q.s(dims.MODULE_COMMENT_REASON[1])} END",
        f"CASE WHEN {_big} THEN {q.s(dims.OVERSIZED_DOC[1])} END",
    ]
)
_IS_DOC = f"list_contains({q.arr(dims.DOC_EXTENSIONS + dims.TEXT_EXTENSIONS)}, {_EXT})"
views.register(
    "v_scored",
    f"""SELECT doc_id, project_id, file_path, bytes, is_doc, kinds,
      ({q.points(dims.ENTRY_RULES, _ecols)} + CASE WHEN {_big} THEN {dims.OVERSIZED_ENTRY[0]} ELSE 0 END + coalesce(list_sum(scores), 0)
        + CASE WHEN {_e_io} THEN 10 ELSE 0 END + CASE WHEN {_e_net} THEN 10 ELSE 0 END)::BIGINT AS entry_score,
      {_reasons_sql(_e_parts)} AS entry_reasons,
      ({q.points(dims.DOC_RULES, _dcols)} + CASE WHEN {_comment} THEN {dims.MODULE_COMMENT_REASON[0]} ELSE 0 END
        + CASE WHEN {_big} THEN {dims.OVERSIZED_DOC[0]} ELSE 0 END)::BIGINT AS doc_score, {_reasons_sql(_d_parts)} AS doc_reasons
      FROM (SELECT *, {_IS_DOC} AS is_doc FROM v_signals)""",
)


def is_doc_file():
    return F.lower(paths.extname(P)).isin(dims.DOC_EXTENSIONS + dims.TEXT_EXTENSIONS)


@query("entry_score", "SELECT doc_id, entry_score AS score, entry_reasons AS reasons FROM v_scored")
def _(spark, sf):
    df = corpus.tree_files(spark, sf).withColumn("s", signals.source_signals(P, F.col("content")))
    e = signals.entry_score(P, F.col("bytes"), F.col("s"))
    return df.withColumn("e", e).select("doc_id", "e.score", F.array_join("e.reasons", "|").alias("reasons"))


@query("documentation_score", "SELECT doc_id, doc_score AS score, doc_reasons AS reasons FROM v_scored")
def _(spark, sf):
    d = signals.documentation_score(P, is_doc_file(), F.col("content"), F.col("bytes"))
    return corpus.tree_files(spark, sf).withColumn("d", d).select(
        "doc_id", "d.score", F.array_join("d.reasons", "|").alias("reasons")
    )


# --- small text columns ---------------------------------------------------------------------------


@query(
    "split_identifier",
    """SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(code, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
      '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1), '|') AS parts FROM units""",
)
def _(spark, sf):
    return corpus.units(spark, sf).select("id", F.array_join(questions.split_identifier(F.col("code")), "|").alias("parts"))


@query("estimate_tokens", "SELECT id, CAST(ceil(length(code) / 3) AS BIGINT) AS tokens FROM units")
def _(spark, sf):
    from srcloom.functions import tokens

    return corpus.units(spark, sf).select("id", tokens.estimate(F.col("code")).alias("tokens"))


_URL = """CASE c_custkey % 7 WHEN 0 THEN concat('https://github.com/', lower(c_mktsegment), '/', replace(c_name, '#', '-'), '.git/')
  WHEN 1 THEN concat('git@github.com:', c_mktsegment, '/', replace(c_name, '#', '_'), '.git') WHEN 2 THEN concat(' github.com/', c_mktsegment, '/', c_name)
  WHEN 3 THEN concat(c_mktsegment, '/', replace(c_name, '#', '.'), '?tab=readme#top') WHEN 4 THEN concat('http://github.com/', c_name)
  WHEN 5 THEN '' ELSE concat('owner/../', c_name, '//') END"""


@query(
    "parse_repo_ref",
    f"""SELECT key, normal, ok, CASE WHEN ok THEN parts[1] END AS owner, CASE WHEN ok THEN parts[2] END AS repo,
      CASE WHEN ok THEN concat('https://github.com/', parts[1], '/', parts[2], '.git') END AS url FROM (
      SELECT *, len(parts) = 2 AND coalesce(list_bool_and(list_transform(parts, lambda x: regexp_matches(x, '^[A-Za-z0-9._-]+$') AND x <> '.' AND x <> '..')), true) AS ok FROM (
      SELECT c_custkey AS key, lower(regexp_replace(regexp_replace(regexp_replace({q.trim('u')}, '(?:/)+$', ''), '(?:\\.git)+$', ''), '(?:/)+$', '')) AS normal,
        list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace({q.trim('u')}, '(?:/)+$', ''),
          '^(?:git@github\\.com:|https://github\\.com/|http://github\\.com/|github\\.com/)', ''), '^[^?#]*'), '(?:\\.git)+$', ''), '(?:/)+$', ''), '/'), lambda x: x <> '') AS parts
      FROM (SELECT c_custkey, {_URL} AS u FROM customer)))""",
)
def _(spark, sf):
    df = corpus.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.expr(_URL).alias("u"))
    return df.withColumn("r", paths.parse_repository(F.col("u"))).select(
        "key", paths.normalize_git_remote(F.col("u")).alias("normal"), "r.ok", "r.owner", "r.repo", "r.url"
    )


@query(
    "safe_file_name",
    f"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace({q.trim('text')}, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'briefing') AS name FROM documents""",
)
def _(spark, sf):
    return corpus.table(spark, sf, "documents").select("doc_id", paths.safe_file_name(F.col("text")).alias("name"))


# --- questions -----------------------------------------------------------------------------------

QC = "query"
SQL_PHRASES = f"list_filter(list_transform({q.exall('query', dims.Q_PHRASE, 1)}, lambda x: {q.trim('x')}), lambda x: x <> '')"
SQL_PATHS = q.exall("query", dims.Q_PATH, 0)
SQL_CONSTS = q.exall("query", dims.Q_CONSTANT, 0)
_IDENTS = f"list_filter({q.exall('query', dims.Q_QUOTED, 1)} || {q.exall('query', dims.Q_BARE, 0)}, lambda x: length(x) > 2)"
_NEEDLES = (
    f"list_filter({SQL_PHRASES} || {SQL_PATHS} || {SQL_CONSTS} || {q.exall('query', dims.Q_DOTTED, 0)} || "
    f"{q.exall('query', dims.Q_IDENT, 0)}, lambda x: length(x) >= 3)"
)
_SHORT = f"list_transform({SQL_PHRASES} || {SQL_CONSTS}, lambda x: lower(x))"


def _ordered(name: str) -> str:
    return f"list_filter({name}, lambda x, i: list_position({name}, x) = i)"


def _any(text, words):
    return q.any_of(text, words)


_LOWQ = f"lower({q.trim('query')})"
INTENT_SQL = f"""CASE WHEN {_any(_LOWQ, dims.OVERVIEW_QUERY_WORDS)} THEN CASE WHEN {_any(_LOWQ, dims.BUSINESS_WORDS)} THEN 'business_overview' ELSE 'architecture_overview' END
  WHEN {_any(_LOWQ, dims.RISK_WORDS)} THEN 'risk_or_gap_analysis' WHEN {_any(_LOWQ, dims.DEPENDENCY_WORDS)} THEN 'dependency_explanation'
  WHEN {q.m(_LOWQ, dims.FILE_QUESTION)} THEN 'file_explanation' WHEN {_any(_LOWQ, dims.BUSINESS_WORDS)} THEN 'business_overview'
  WHEN {_any(_LOWQ, dims.ARCHITECTURE_WORDS)} THEN 'architecture_overview' WHEN {_any(_LOWQ, dims.WORKFLOW_WORDS)} THEN 'workflow_trace'
  WHEN {q.m('query', dims.QUOTED_SYMBOL)} OR ({q.m('query', dims.CAPITAL_SYMBOL)} AND {q.m('query', dims.SYMBOL_WORD, 'i')}) THEN 'specific_symbol'
  ELSE 'general_code_question' END"""
MODE_SQL = f"""CASE WHEN intent IN ('file_explanation', 'specific_symbol') THEN 'exact'
  WHEN {q.m('query', dims.QUOTED_LITERAL)} OR {q.m('query', dims.ERROR_WORD, 'i')} OR {q.m('query', dims.Q_CONSTANT)} OR {q.m('query', dims.LONG_NUMBER)} THEN 'literal'
  WHEN intent IN ('architecture_overview', 'business_overview') THEN 'summary_graph'
  WHEN intent IN ('workflow_trace', 'dependency_explanation', 'risk_or_gap_analysis') THEN 'graph_hybrid' ELSE 'hybrid' END"""
TRAVERSAL_SQL = f"CASE WHEN {q.m('lower(query)', dims.DOWNSTREAM_QUERY)} THEN 'downstream' WHEN {q.m('lower(query)', dims.UPSTREAM_QUERY)} THEN 'upstream' ELSE 'bidirectional' END"
_raw = q.exall("query", dims.Q_TERM, 0)
views.register(
    "v_terms",
    f"""SELECT query_id, value, code_like, ord FROM (
      SELECT query_id, value, min(pos) AS first_pos, arg_max(code_like, pos) AS code_like,
        row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS ord FROM (
        SELECT query_id, lower(raw[i]) AS value, {q.m('raw[i]', dims.Q_CODE_LIKE)} AS code_like, i AS pos
        FROM (SELECT query_id, {_raw} AS raw FROM queries), range(1, len(raw) + 1) r(i))
      WHERE NOT list_contains({q.arr(dims.STOP_WORDS)}, value) GROUP BY query_id, value)""",
)
views.register(
    "v_features",
    f"""SELECT query_id, project_id, query, intent, {MODE_SQL} AS mode, {TRAVERSAL_SQL} AS traversal, idents, paths, phrases, {_ordered('needles')} AS needles, {_ordered('short_needles')} AS short_needles,
      coalesce(terms, CAST([] AS STRUCT(value VARCHAR, code_like BOOLEAN)[])) AS terms FROM (
      SELECT *, {INTENT_SQL} AS intent, {_ordered('raw_idents')} AS idents FROM (
        SELECT query_id, project_id, query, {_IDENTS} AS raw_idents, {SQL_PATHS} AS paths, {SQL_PHRASES} AS phrases, {_NEEDLES} AS needles, {_SHORT} AS short_needles FROM queries))
      LEFT JOIN (SELECT query_id, list({{'value': value, 'code_like': code_like}} ORDER BY ord) AS terms FROM v_terms GROUP BY query_id) USING (query_id)""",
)


def _list_query(name, fn, column):
    @query(name, f"SELECT query_id, array_to_string({column}, '|') AS found FROM v_features")
    def _(spark, sf):
        return corpus.queries(spark, sf).select("query_id", F.array_join(fn(QC), "|").alias("found"))


_list_query("extract_identifiers", questions.identifiers, "idents")
_list_query("extract_paths", questions.paths_in, "paths")
_list_query("extract_phrases", questions.phrases, "phrases")
_list_query("extract_needles", questions.needles, "needles")
_list_query("extract_short_needles", questions.short_needles, "short_needles")


@query("extract_terms", "SELECT query_id, value, code_like, ord FROM v_terms")
def _(spark, sf):
    return (
        corpus.queries(spark, sf)
        .select("query_id", F.posexplode(questions.terms(QC)).alias("pos", "t"))
        .select("query_id", "t.value", "t.code_like", (F.col("pos") + 1).alias("ord"))
    )


@query("classify_intent", "SELECT query_id, intent FROM v_features")
def _(spark, sf):
    return corpus.queries(spark, sf).select("query_id", questions.intent(QC).alias("intent"))


def _plan_case(render) -> str:
    return "CASE mode " + " ".join(f"WHEN {q.s(k)} THEN {render(v)}" for k, v in dims.PLANS.items()) + " END"


views.register(
    "v_plans",
    f"""SELECT query_id, project_id, query, intent, mode,
      CASE WHEN mode = 'graph_hybrid' AND intent = 'workflow_trace' THEN {q.arr(dims.WORKFLOW_TRACE_EVIDENCE)} ELSE {_plan_case(lambda v: q.arr(v[0]))} END AS required_evidence,
      {_plan_case(lambda v: q.arr(v[1]))} AS preferred_sources, {_plan_case(lambda v: q.s(v[2]))} AS graph_direction,
      {_plan_case(lambda v: str(v[3][0]))} AS code_budget, {_plan_case(lambda v: str(v[3][1]))} AS docs_budget, {_plan_case(lambda v: str(v[3][2]))} AS tests_budget,
      mode = 'exact' AS use_exact, mode IN ('summary_graph', 'graph_hybrid') AS use_graph,
      mode = 'summary_graph' OR (mode = 'graph_hybrid' AND intent IN ('workflow_trace', 'risk_or_gap_analysis')) AS include_summary,
      CAST({_plan_case(lambda v: str(v[4]))} AS DOUBLE) AS ratio, {_plan_case(lambda v: q.s(v[5]))} AS reason FROM v_features""",
)


@query(
    "plan_query",
    """SELECT query_id, intent, mode, array_to_string(required_evidence, '|') AS required_evidence, array_to_string(preferred_sources, '|') AS preferred_sources,
      graph_direction, code_budget, docs_budget, tests_budget, use_exact, true AS use_lexical, use_graph, include_summary, ratio, reason FROM v_plans""",
)
def _(spark, sf):
    df = questions.with_plan(corpus.queries(spark, sf)).drop("project_id", "query")
    return df.withColumns({c: F.array_join(c, "|") for c in ("required_evidence", "preferred_sources")})


FOLLOWUP_SQL = "CASE " + " ".join(
    f"WHEN {q.m('lower(query)', p)}{' OR ' + q.m('query', dims.QUOTED_LITERAL) if n == 'code_explanation' else ''} THEN {q.s(n)}"
    for n, p in dims.FOLLOWUP_INTENTS
) + " ELSE 'general_followup' END"


@query("classify_followup", f"SELECT query_id, {FOLLOWUP_SQL} AS followup FROM queries")
def _(spark, sf):
    return corpus.queries(spark, sf).select("query_id", questions.followup_intent(QC).alias("followup"))


EXPAND_SQL = "concat(query, CASE followup " + " ".join(
    f"WHEN {q.s(k)} THEN {q.s(' ' + v)}" for k, v in dims.FOLLOWUP_HINTS.items()
) + " ELSE '' END)"


@query("expand_followup_query", f"SELECT query_id, {EXPAND_SQL} AS expanded FROM (SELECT *, {FOLLOWUP_SQL} AS followup FROM queries)")
def _(spark, sf):
    return corpus.queries(spark, sf).select(
        "query_id", questions.expand_followup(F.col(QC), questions.followup_intent(QC)).alias("expanded")
    )


@query("traversal_mode", "SELECT query_id, traversal FROM v_features")
def _(spark, sf):
    return corpus.queries(spark, sf).select("query_id", questions.traversal(QC).alias("traversal"))


@query(
    "unit_text",
    """SELECT id, md5(concat_ws(chr(10), file_path, kind, name, coalesce(docstring, ''), array_to_string(imports, chr(10)),
        array_to_string(exported_names, chr(10)), array_to_string(called_functions, chr(10)), code)) AS search_text,
      md5(lower(concat_ws(chr(10), file_path, name, kind, coalesce(docstring, ''), array_to_string(exported_names, ' '), array_to_string(called_functions, ' '), code))) AS briefing_text,
      md5(lower(concat_ws(chr(10), file_path, name, code, array_to_string(imports, chr(10)), array_to_string(exported_names, chr(10))))) AS rerank_text,
      md5(lower(concat_ws(chr(10), file_path, name, array_to_string(exported_names, ' '), array_to_string(called_functions, ' '), code))) AS workflow_text FROM units""",
)
def _(spark, sf):
    from srcloom.functions import unittext

    return corpus.units(spark, sf).select(
        "id",
        F.md5(unittext.search_text()).alias("search_text"),
        F.md5(unittext.briefing_text()).alias("briefing_text"),
        F.md5(unittext.rerank_text()).alias("rerank_text"),
        F.md5(unittext.workflow_text()).alias("workflow_text"),
    )


@query(
    "unit_length_penalty",
    f"""SELECT id, CASE WHEN {q.m('file_path', dims.DOC_FILE, 'i')} AND {q.m(PL, dims.README_ANYWHERE)} THEN 0
      WHEN {q.m('file_path', dims.DOC_FILE, 'i')} AND n > 1000 THEN -30 WHEN n > 1200 THEN -32 WHEN n > 600 THEN -20 WHEN n > 300 THEN -8 ELSE 0 END AS penalty,
      CASE kind WHEN 'class' THEN 3.0::DOUBLE WHEN 'function' THEN 2.5 WHEN 'method' THEN 2.0 ELSE 1.5 END AS priority FROM (SELECT *, end_line - start_line + 1 AS n FROM units)""",
)
def _(spark, sf):
    from srcloom.functions import unittext

    return corpus.units(spark, sf).select("id", unittext.length_penalty().alias("penalty"), unittext.kind_priority().alias("priority"))
