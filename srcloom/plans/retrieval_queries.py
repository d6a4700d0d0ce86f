"""Registered queries for the retrieval channels, fusion, reranking and the eval."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.operators import fuse, retrieve
from srcloom.registry import query
from srcloom.plans import answer
from srcloom.sources import corpus
from srcloom.staging import shared

K = dims.FUSED_TOP_K
VF = dims.VENDORED_FACTOR
SEARCH = (
    "concat_ws(chr(10), file_path, kind, name, coalesce(docstring, ''), array_to_string(imports, chr(10)), "
    "array_to_string(exported_names, chr(10)), array_to_string(called_functions, chr(10)), code)"
)


def _split(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), "
        "lambda x: lower(x)), lambda x: length(x) > 1)"
    )


views.register(
    "v_unit_facts",
    f"""SELECT *, lower(file_path) AS lp, lower(name) AS ln, lower(code) AS lc, {SEARCH} AS raw, lower({SEARCH}) AS low,
      list_transform(exported_names, lambda x: lower(x)) AS le, list_transform(imports, lambda x: lower(x)) AS li,
      list_transform(called_functions, lambda x: lower(x)) AS lf, {_split('name')} || {_split('file_path')} AS parts,
      CASE WHEN {q.m('file_path', dims.SUPPORT_PATH, 'i')} THEN 8 ELSE 0 END + CASE WHEN {q.m('code', dims.SUPPORT_CODE, 'i')} THEN 8 ELSE 0 END AS support
      FROM units""",
)
_lidents = "list_transform(idents, lambda x: lower(x))"
_lpaths = "list_transform(paths, lambda x: lower(x))"
_anyl = "len(list_filter({0}, lambda x: {1})) > 0"
_EXACT = f"""(CASE WHEN {_anyl.format(_lpaths, "ends_with(lp, x)")} THEN 20 WHEN {_anyl.format(_lpaths, "contains(lp, x)")} THEN 12 ELSE 0 END
  + CASE WHEN list_contains({_lidents}, ln) THEN 18 WHEN {_anyl.format(_lidents, "contains(ln, x)")} THEN 8 ELSE 0 END
  + CASE WHEN list_has_any(le, {_lidents}) THEN 10 ELSE 0 END + CASE WHEN contains(lower(query), lp) THEN 10 ELSE 0 END)"""


def _sum(lst: str, expr: str) -> str:
    return f"coalesce(list_sum(list_transform({lst}, lambda x: {expr})), 0)"


_const = q.m("x", dims.Q_CONSTANT)
_GREP = f"""({_sum(_lpaths, "CASE WHEN ends_with(lp, x) THEN 30 WHEN contains(lp, x) THEN 15 ELSE 0 END")}
  + {_sum("needles", f'''CASE WHEN file_path = x OR ends_with(lp, lower(x)) THEN 28 ELSE 0 END + CASE WHEN name = x THEN 24 WHEN ln = lower(x) THEN 20 ELSE 0 END
    + CASE WHEN list_contains(exported_names, x) THEN 18 ELSE 0 END + CASE WHEN len(list_filter(imports, lambda y: contains(y, x))) > 0 THEN 14 ELSE 0 END
    + CASE WHEN contains(code, x) THEN CASE WHEN {_const} THEN 26 ELSE 18 END WHEN contains(lc, lower(x)) THEN CASE WHEN {_const} THEN 18 ELSE 10 END ELSE 0 END
    + CASE WHEN contains(raw, x) THEN CASE WHEN {_const} THEN 12 ELSE 6 END WHEN contains(low, lower(x)) THEN CASE WHEN {_const} THEN 8 ELSE 3 END ELSE 0 END''')}
  + {_sum("terms", f'''len(list_filter({_split("x.value")}, lambda y: list_contains(parts, y))) * CASE WHEN x.code_like THEN 6 ELSE 2 END
    + CASE WHEN ln = x.value THEN 10 ELSE 0 END + CASE WHEN contains(lp, x.value) THEN CASE WHEN x.code_like THEN 8 ELSE 3 END ELSE 0 END''')}
  + CASE WHEN {q.m('query', dims.GREP_SUPPORT_QUERY, 'i')} THEN support ELSE 0 END)"""
_LEX = f"""({_sum(_lpaths, "CASE WHEN ends_with(lp, x) THEN 18 WHEN contains(lp, x) THEN 9 ELSE 0 END")}
  + {_sum("phrases", "CASE WHEN contains(low, lower(x)) THEN 14 ELSE 0 END")}
  + {_sum("terms", '''CASE WHEN ln = x.value THEN 10 WHEN contains(ln, x.value) THEN 6 ELSE 0 END + CASE WHEN contains(lp, x.value) THEN CASE WHEN x.code_like THEN 10 ELSE 5 END ELSE 0 END
    + CASE WHEN len(list_filter(le, lambda y: contains(y, x.value))) > 0 THEN CASE WHEN x.code_like THEN 10 ELSE 4 END ELSE 0 END
    + CASE WHEN len(list_filter(li, lambda y: contains(y, x.value))) > 0 THEN CASE WHEN x.code_like THEN 8 ELSE 4 END ELSE 0 END
    + CASE WHEN len(list_filter(lf, lambda y: contains(y, x.value))) > 0 THEN CASE WHEN x.code_like THEN 8 ELSE 3 END ELSE 0 END
    + CASE WHEN contains(lower(coalesce(docstring, '')), x.value) THEN 3 ELSE 0 END
    + CASE WHEN contains(lc, x.value) THEN CASE WHEN x.code_like THEN 14 ELSE 1 END ELSE 0 END''')})"""
_ocols = {"path_lower": "lp", "overview_text": "concat_ws(' ', lp, ln, lc)"}
_OVER = f"({q.points(dims.OVERVIEW_CHANNEL, _ocols)} + CASE WHEN contains(lower(query), 'sales') AND {q.m('lc', dims.SALES_CODE)} THEN 8 ELSE 0 END)"
views.register(
    "v_pair_scores",
    f"""SELECT query_id, project_id, id, file_path, start_line, is_vendored, exact::DOUBLE AS exact,
      grep * CASE WHEN is_vendored THEN {VF}::DOUBLE ELSE 1 END AS grep, lexical * CASE WHEN is_vendored THEN {VF}::DOUBLE ELSE 1 END AS lexical,
      overview * CASE WHEN is_vendored THEN {VF}::DOUBLE ELSE 1 END AS overview FROM (
      SELECT query_id, project_id, id, file_path, start_line, is_vendored, {_EXACT} AS exact, {_GREP} AS grep, {_LEX} AS lexical, {_OVER} AS overview
      FROM v_features JOIN v_unit_facts USING (project_id))""",
)
KS = {"exact": K, "overview": K, "grep": 2 * K, "lexical": K}


def _hits_sql(channel: str, k: int) -> str:
    return (
        f"SELECT * FROM (SELECT query_id, project_id, id AS unit_id, '{channel}' AS channel, {channel} AS score, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY {channel} DESC, file_path, start_line, id) AS rank, is_vendored "
        f"FROM v_pair_scores WHERE {channel} > 0) WHERE rank <= {k}"
    )


views.register("v_hits", " UNION ALL ".join(_hits_sql(c, KS[c]) for c in retrieve.CHANNELS))
_DEFAULT_K = {"exact": 10, "grep": 20, "lexical": 10, "overview": 12}


def _channel_query(channel: str):
    @query(f"{channel}_search", _hits_sql(channel, _DEFAULT_K[channel]))
    def _(spark, sf):
        hits = retrieve.channel_hits(corpus.queries(spark, sf), corpus.units(spark, sf), channel, _DEFAULT_K[channel])
        return hits.withColumn("score", F.round("score", 6))


for _c in retrieve.CHANNELS:
    _channel_query(_c)


# --- fusion -------------------------------------------------------------------------------------


def _seen_sql(order) -> str:
    return f"list_position({q.arr(order)}, channel) * 100000 + rank"


def _top_sql(inner: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS ord FROM ({inner})) WHERE ord <= {k}"


def _merge_sql(source: str, k: int) -> str:
    return _top_sql(
        "SELECT query_id, project_id, unit_id, max(score) AS score, min(rank) AS keyword_rank, bool_or(is_vendored) AS is_vendored, "
        f"min(seen) AS seen FROM ({source}) GROUP BY ALL",
        k,
    )


def judged_units(spark, sf):
    """Units are cut from the files and judged once; the later steps read them back."""
    return shared(spark, sf, "judged", lambda: answer.judged(corpus.units(spark, sf)))


def _hits(spark, sf):
    return shared(
        spark, sf, "hits", lambda: retrieve.all_channels(corpus.queries(spark, sf), judged_units(spark, sf), KS)
    )


@query(
    "merge_channels",
    f"SELECT query_id, project_id, unit_id, round(score, 6) AS score, keyword_rank, is_vendored, ord FROM ({_merge_sql(f'SELECT *, {_seen_sql(fuse.PLAN_ORDER)} AS seen FROM v_hits', 2 * K)})",
)
def _(spark, sf):
    return fuse.merge(_hits(spark, sf), 2 * K).withColumn("score", F.round("score", 6))


_KEEP = _top_sql(
    f"""SELECT query_id, project_id, unit_id, arg_max(score, (score, -seen)) AS score, arg_max(rank, (score, -seen)) AS keyword_rank,
      arg_max(is_vendored, (score, -seen)) AS is_vendored, min(seen) AS seen FROM (SELECT *, {_seen_sql(fuse.PLAN_ORDER)} AS seen FROM v_hits) GROUP BY ALL""",
    2 * K,
)


@query("merge_keep_best", f"SELECT query_id, project_id, unit_id, round(score, 6) AS score, keyword_rank, is_vendored, ord FROM ({_KEEP})")
def _(spark, sf):
    return fuse.keep_best(_hits(spark, sf), 2 * K).withColumn("score", F.round("score", 6))


views.register(
    "v_planned",
    f"""SELECT h.*, {_seen_sql(fuse.PLAN_ORDER)} AS seen FROM v_hits h JOIN v_plans p USING (query_id)
      WHERE channel IN ('grep', 'lexical') OR (channel = 'exact' AND use_exact) OR (channel = 'overview' AND intent IN ('architecture_overview', 'business_overview'))""",
)
views.register(
    "v_fused",
    _merge_sql("SELECT * EXCLUDE (seen), seen FROM v_planned", 2 * K)
    + " UNION ALL "
    + _merge_sql(
        f"SELECT *, {_seen_sql(fuse.FALLBACK_ORDER)} AS seen FROM v_hits WHERE query_id NOT IN (SELECT query_id FROM v_planned)", 2 * K
    ),
)


def _plans(spark, sf):
    return shared(spark, sf, "planned", lambda: answer.plans(corpus.queries(spark, sf)))


@query(
    "retrieve_by_plan",
    "SELECT query_id, project_id, unit_id, round(score, 6) AS score, keyword_rank, is_vendored, ord FROM v_fused",
)
def _(spark, sf):
    return fuse.retrieve_by_plan(_plans(spark, sf), _hits(spark, sf)).withColumn("score", F.round("score", 6))


# --- rerank ---------------------------------------------------------------------------------------

_RR_TEXT = "lower(concat_ws(chr(10), file_path, name, code, array_to_string(imports, chr(10)), array_to_string(exported_names, chr(10))))"
_STAGE = "lower(concat_ws(' ', lp, name, code))"


def workflow_sql(scale: int) -> list[tuple[str, int, str]]:
    cols = {"path_lower": "lp", "stage_text": "stage_text"}
    out = []
    for row in dims.WORKFLOW_EVIDENCE:
        asked = f" AND {q.m('lq', row[3])}" if row[3] else ""
        out.append((f"({q.m('lq', dims.WORKFLOW_QUERY)} AND {q.m(cols[row[4]], row[5])}{asked})", row[scale], row[2]))
    return out


_OV = [
    (f"(intent IN ('architecture_overview', 'business_overview') AND {c})", p, r)
    for c, p, r in [
        (q.m("file_path", dims.DOC_FILE, "i"), 8, "documentation overview source"),
        (q.m("lp", dims.RERANK_ENTRY), 7, "entry point source"),
        (q.m("lp", dims.RERANK_PIPELINE), 6, "central workflow source"),
        (q.m("lp", dims.CORE_SUBSYSTEM), 3, "core subsystem source"),
    ]
]


def total_sql(table) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in table) + ")"


_WF = workflow_sql(0)
TEST_DEMOTED = f"({q.m('file_path', dims.TEST_FILE)} AND NOT {q.m('query', dims.TEST_QUERY, 'i')})"
_RR_REASONS = q.compact(
    [
        "concat('keyword rank ', keyword_rank)",
        "CASE WHEN literal THEN 'exact query literal/path match' END",
        "CASE WHEN n_terms > 0 THEN concat(n_terms, ' query term matches') END",
        *[f"CASE WHEN {c} THEN {q.s(r)} END" for c, _, r in _WF + _OV],
        f"CASE WHEN {TEST_DEMOTED} THEN 'test source demoted for non-test query' END",
        "CASE WHEN is_vendored THEN 'vendored source demoted' END",
    ]
)
views.register(
    "v_reranked",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM (
      SELECT query_id, project_id, unit_id, file_path, name, kind, hit AS original_score, keyword_rank, is_vendored, ord AS seen,
        CASE WHEN best > 0 THEN hit / best * 20 ELSE 0 END - (ord - 1) * 0.001::DOUBLE + CASE WHEN literal THEN 28 ELSE 0 END + least(8, n_terms * 2)
          + {total_sql(_WF)} + {total_sql(_OV)} + CASE WHEN {TEST_DEMOTED} THEN -30 ELSE 0 END + CASE WHEN is_vendored THEN -20 ELSE 0 END AS score,
        array_to_string({_RR_REASONS}, '|') AS reasons
      FROM (SELECT f.query_id, f.project_id, f.unit_id, f.score AS hit, max(f.score) OVER (PARTITION BY f.query_id) AS best, f.keyword_rank, f.ord, f.is_vendored,
          u.file_path, u.name, u.kind, v.query, v.intent, lower(v.query) AS lq, u.lp, lower(concat_ws(' ', u.lp, u.name, u.code)) AS stage_text,
          len(list_filter(v.short_needles || list_transform(v.paths, lambda p: lower(p)), lambda x: contains({_RR_TEXT}, x))) > 0 AS literal,
          len(list_filter(v.terms, lambda x: contains(lower(concat_ws(' ', u.file_path, u.name, array_to_string(u.exported_names, ' '))), x.value))) AS n_terms
        FROM v_fused f JOIN v_features v USING (query_id) JOIN v_unit_facts u ON u.project_id = f.project_id AND u.id = f.unit_id))) WHERE rank <= {K}""",
)


@query(
    "rerank",
    """SELECT query_id, project_id, unit_id, file_path, name, kind, round(original_score, 6) AS original_score, keyword_rank, is_vendored, round(score, 6) AS score, reasons, rank FROM v_reranked""",
)
def _(spark, sf):
    planned = _plans(spark, sf)
    units = judged_units(spark, sf)
    out = fuse.rerank(planned, fuse.retrieve_by_plan(planned, _hits(spark, sf)), units)
    return out.withColumns(
        {"reasons": F.array_join("reasons", "|"), "score": F.round("score", 6), "original_score": F.round("original_score", 6)}
    )


# --- retrieval evaluation -----------------------------------------------------------------------------

_EXPECTED = {1: ["src/config/env.ts"], 2: ["src/daily/pipeline.ts"], 3: ["README.md", "src/daily/pipeline.ts"]}


@query(
    "retrieval_eval",
    f"""SELECT query_id, len(list_filter(expected, lambda x: NOT list_contains(ranked, x))) = 0 AS passed,
      array_to_string(list_filter(expected, lambda x: NOT list_contains(ranked, x)), '|') AS missing_files, array_to_string(ranked, '|') AS ranked_files FROM (
      SELECT c.query_id, c.expected, coalesce(r.ranked, CAST([] AS VARCHAR[])) AS ranked FROM (
        SELECT query_id, CASE query {' '.join(f"WHEN {q.s(corpus.GOLDEN_QUESTIONS[k - 1])} THEN {q.arr(v)}" for k, v in _EXPECTED.items())} END AS expected FROM queries) c
      LEFT JOIN (SELECT query_id, list(file_path ORDER BY rank) AS ranked FROM v_reranked GROUP BY query_id) r USING (query_id) WHERE c.expected IS NOT NULL)""",
)
def _(spark, sf):
    from srcloom.functions.paths import strings

    expected = F.lit(None)
    for k, v in _EXPECTED.items():
        expected = F.when(F.col("query") == corpus.GOLDEN_QUESTIONS[k - 1], strings(v)).otherwise(expected)
    all_queries = corpus.queries(spark, sf).withColumn("expected", expected).filter("expected is not null")
    cases = all_queries.select("query_id", "expected")
    asked = all_queries.drop("expected")
    planned = answer.plans(asked)
    out = fuse.evaluate(cases, answer.reranked(planned, asked, judged_units(spark, sf)))
    return out.withColumns({c: F.array_join(c, "|") for c in ("missing_files", "ranked_files")})
