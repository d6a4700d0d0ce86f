"""Registered queries for briefing evidence: census, planning, workflows, sections."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.operators import briefing as br
from srcloom.plans.packing_queries import tokens_sql, truncate_sql
from srcloom.plans.text_queries import buckets_sql
from srcloom.registry import query
from srcloom.sources import corpus
from srcloom.staging import shared

_LP = "lower(file_path)"
_USABLE = f"(NOT is_vendored AND NOT {q.m(_LP, dims.NOISE_FILE)} AND NOT {q.m('file_path', dims.TEST_FILE)})"
_WT = "lower(concat_ws(chr(10), file_path, name, array_to_string(exported_names, ' '), array_to_string(called_functions, ' '), code))"
views.register(
    "v_usable",
    f"SELECT *, {_LP} AS lp, lower(name) AS ln, {_WT} AS wt, {buckets_sql()} AS buckets FROM tree_units WHERE {_USABLE}",
)


def _units(spark, sf):
    return corpus.tree_units(spark, sf)


@query(
    "repository_census",
    f"""SELECT project_id, count(*) AS total_units, count(DISTINCT file_path) AS total_files, count(*) FILTER (WHERE {_USABLE}) AS usable_units,
      count(DISTINCT file_path) FILTER (WHERE {q.m(_LP, dims.NOISE_FILE)}) AS noise_files FROM tree_units GROUP BY project_id""",
)
def _(spark, sf):
    return br.census(_units(spark, sf))


@query(
    "bucket_census",
    """SELECT project_id, bucket, count(*) AS unit_count, count(DISTINCT file_path) AS file_count, array_to_string(list_slice(list_sort(list(DISTINCT file_path)), 1, 5), '|') AS sample_files
      FROM (SELECT project_id, file_path, unnest(buckets) AS bucket FROM v_usable) GROUP BY ALL""",
)
def _(spark, sf):
    return br.bucket_census(_units(spark, sf)).withColumn("sample_files", F.array_join("sample_files", "|"))


_ECOLS = {"path_lower": "lp", "entity_text": "lower(concat_ws(' ', entity, file_path))"}
_CAT = "CASE " + " ".join(f"WHEN {q.m('lower(entity)', p)} THEN {q.s(c)}" for c, p in dims.ENTITY_CATEGORIES) + " ELSE 'domain' END"
views.register(
    "v_entities",
    f"""SELECT project_id, entity, {_CAT} AS category, file_path, concat(start_line, '-', end_line) AS lines, score, rank, id FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, entity) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, entity ORDER BY score DESC, file_path, start_line, id, form, pos) AS rn FROM (
          SELECT *, 20 + {q.points(dims.ENTITY_POINTS, _ECOLS)} - CASE WHEN form = 1 THEN 12 ELSE 0 END AS score FROM (
            SELECT u.*, ms[i] AS entity, 0 AS form, i AS pos FROM (SELECT *, {q.exall('code', dims.MODEL_ENTITY)} AS ms FROM v_usable) u, range(1, len(ms) + 1) r(i)
            UNION ALL SELECT u.*, ms[i], 1, i FROM (SELECT *, {q.exall('code', dims.TYPE_ENTITY)} AS ms FROM v_usable) u, range(1, len(ms) + 1) r(i) WHERE length(ms[i]) >= 3)))
      WHERE rn = 1) WHERE rank <= 14""",
)


@query("domain_entities", "SELECT project_id, entity AS name, category, file_path, lines, score, rank FROM v_entities")
def _(spark, sf):
    return br.domain_entities(_units(spark, sf)).drop("id")


_TERMS = q.arr(dims.PRODUCT_TERMS)
_COUNTS = " UNION ALL ".join(
    f"SELECT project_id, {q.s(t)} AS term, sum(least(12, len({q.exall('wt', f'{chr(92)}b{t}s?{chr(92)}b', 0)})) * CASE WHEN {q.m('file_path', dims.DOC_FILE, 'i')} THEN 4 ELSE 1 END) AS points FROM v_usable GROUP BY project_id"
    for t in dims.PRODUCT_TERMS
)
views.register(
    "v_product",
    f"""SELECT project_id, concat(upper(left(term, 1)), substr(term, 2)) AS signal, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, term) AS rank FROM (
        SELECT project_id, term, sum(points)::BIGINT AS score FROM ({_COUNTS} UNION ALL SELECT project_id, unnest(list_filter({_TERMS}, lambda t: contains(lower(entity), t))), 20 FROM v_entities)
        GROUP BY ALL) WHERE score > 0) WHERE rank <= 8""",
)


@query("product_signals", "SELECT * FROM v_product")
def _(spark, sf):
    units = _units(spark, sf)
    return br.product_signals(units, br.domain_entities(units))


# --- bucket evidence -----------------------------------------------------------------------------------

_BW = " + ".join(
    f"CASE WHEN {q.m('lp', p)} THEN CASE WHEN list_contains({q.arr(bs)}, bucket) THEN {i} ELSE {o} END ELSE 0 END"
    for p, bs, i, o in dims.BUCKET_PATH_WEIGHTS
)
_DOC = q.m("file_path", dims.DOC_FILE, "i")
_NARROW = f"({_DOC} AND NOT {q.m('lp', dims.OVERVIEW_DOC)} AND {q.m('lp', dims.NARROW_DOC_DIR)})"
views.register(
    "v_bucket_scores",
    f"""SELECT *, 100 + {q.points(dims.PATH_WEIGHTS, {'path_lower': 'lp'})} + {_BW}
      + CASE WHEN {_NARROW} THEN CASE WHEN bucket = 'overview_docs' THEN {dims.NARROW_DOC_POINTS[0]} ELSE {dims.NARROW_DOC_POINTS[1]} END ELSE 0 END
      + CASE WHEN kind = 'module' THEN 20 ELSE 0 END + CASE WHEN {_DOC} THEN CASE WHEN bucket = 'overview_docs' THEN 20 ELSE -12 END ELSE 0 END
      - least(25, greatest(0, len(string_split(file_path, '/')) - 4) * 3) AS score FROM (SELECT * EXCLUDE (buckets), unnest(buckets) AS bucket FROM v_usable)""",
)
_PARTS = "string_split(file_path, '/')"
views.register(
    "v_bucket_seq",
    f"""SELECT *, concat(project_id, ':', bucket) AS g, row_number() OVER (PARTITION BY project_id, bucket ORDER BY score DESC, file_path, start_line, id) AS step,
      {q.lit_map('bucket', dims.BUCKET_BUDGETS, '2')} AS budget, CASE WHEN bucket IN ('api_handlers', 'data_model') THEN 4 ELSE 2 END AS dir_max, CASE WHEN starts_with(flow, 'export-') THEN 1 ELSE 2 END AS flow_max FROM (
      SELECT project_id, id, file_path, bucket, score, start_line, CASE WHEN len({_PARTS}) <= 1 THEN '.' ELSE array_to_string(list_slice({_PARTS}, 1, least(len({_PARTS}) - 1,
          CASE WHEN list_contains({q.arr(dims.DEEP_DIRECTORY_ROOTS)}, {_PARTS}[1]) THEN 3 ELSE 2 END)), '/') END AS dir,
        lower(regexp_replace({q.basename('file_path')}, '\\.[^.]+$', '')) AS flow FROM v_bucket_scores)""",
)
views.register(
    "v_selected",
    """WITH RECURSIVE walk AS (SELECT g, step, true AS kept, 1 AS n, [dir] AS dirs, [flow] AS flows FROM v_bucket_seq WHERE step = 1
        UNION ALL SELECT g, step, kept, n + CASE WHEN kept THEN 1 ELSE 0 END, CASE WHEN kept THEN list_append(dirs, dir) ELSE dirs END, CASE WHEN kept THEN list_append(flows, flow) ELSE flows END FROM (
          SELECT w.g, s.step, w.n, w.dirs, w.flows, s.dir, s.flow, w.n < s.budget AND len(list_filter(w.dirs, lambda d: d = s.dir)) < s.dir_max AND len(list_filter(w.flows, lambda f: f = s.flow)) < s.flow_max AS kept
          FROM walk w JOIN v_bucket_seq s ON s.g = w.g AND s.step = w.step + 1))
      SELECT s.project_id, s.bucket, s.id, s.file_path, s.score, row_number() OVER (PARTITION BY s.project_id, s.bucket ORDER BY s.step) AS pos FROM v_bucket_seq s JOIN walk w ON w.g = s.g AND w.step = s.step WHERE w.kept""",
)


def _scored(spark, sf):
    return br.bucket_scores(_units(spark, sf))


@query("bucket_selection", "SELECT * FROM v_selected")
def _(spark, sf):
    return br.bucket_selection(_scored(spark, sf)).select("project_id", "bucket", "id", "file_path", "score", "pos")


_SECTIONS = list(dims.SECTION_BUCKETS)
_PRODUCT_SECTIONS = [s for s in _SECTIONS if re.search(dims.PRODUCT_SECTION, s, re.I)]
_SB = "(VALUES " + ", ".join(
    f"({q.s(s)}, {q.s(b)}, {i})" for s, bs in dims.SECTION_BUCKETS.items() for i, b in enumerate(bs)
) + ") AS sb(section, bucket, place)"
views.register(
    "v_overview_units",
    f"""SELECT project_id, id, file_path, rank, unnest({q.arr(_PRODUCT_SECTIONS)}) AS section FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, file_path, start_line, id) AS rank
      FROM v_bucket_scores WHERE bucket = 'overview_docs' AND {q.m('lp', dims.OVERVIEW_DOC)}) WHERE rank <= 2""",
)
views.register(
    "v_grounding",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY score DESC, file_path, start_line, id) AS rank FROM (
      SELECT project_id, section, id, file_path, start_line, max(score) AS score FROM v_bucket_scores JOIN {_SB} USING (bucket)
      WHERE list_contains({q.arr(dims.GROUNDING_BUCKETS)}, bucket) AND NOT {_DOC} GROUP BY ALL)) WHERE rank <= 4""",
)
views.register(
    "v_evidence_plan",
    f"""SELECT project_id, section, id, file_path, row_number() OVER (PARTITION BY project_id, section ORDER BY first_at, id) AS ord FROM (
      SELECT project_id, section, id, file_path, min((tier, place)) AS first_at FROM (
        SELECT project_id, section, id, file_path, 0 AS tier, rank AS place FROM v_overview_units UNION ALL
        SELECT project_id, section, id, file_path, 1, rank FROM v_grounding UNION ALL
        SELECT project_id, section, id, file_path, 2, place * 1000 + pos FROM v_selected JOIN {_SB} USING (bucket)) GROUP BY ALL)""",
)


@query("product_overview_units", "SELECT project_id, section, id, rank FROM v_overview_units")
def _(spark, sf):
    return br.product_overview(_scored(spark, sf)).select("project_id", "section", "id", "rank")


@query("code_grounding_units", "SELECT project_id, section, id, score, rank FROM v_grounding")
def _(spark, sf):
    return br.code_grounding(_scored(spark, sf)).select("project_id", "section", "id", "score", "rank")


def _plan(spark, sf):
    return br.evidence_plan(_scored(spark, sf))


@query("evidence_plan", "SELECT * FROM v_evidence_plan")
def _(spark, sf):
    return _plan(spark, sf)


# The small layout lacks whole buckets, so it is the one to look for gaps in.
_STEPS = ["v_usable", "v_bucket_scores", "v_bucket_seq", "v_selected", "v_overview_units", "v_grounding", "v_evidence_plan"]
for _name in _STEPS:
    _text = re.sub(r"\btree_units\b", "units", views.VIEWS[_name])
    for _other in _STEPS:
        _text = re.sub(rf"\b{_other}\b", f"{_other}_small", _text)
    views.register(f"{_name}_small", _text)


@query(
    "missing_buckets",
    f"""SELECT p.project_id, sb.section, sb.bucket FROM (SELECT DISTINCT project_id FROM units) p, {_SB}
      WHERE NOT EXISTS (SELECT 1 FROM v_evidence_plan_small e WHERE e.project_id = p.project_id AND e.section = sb.section AND list_contains({buckets_sql('e.file_path')}, sb.bucket))""",
)
def _(spark, sf):
    units = corpus.units(spark, sf)
    return br.missing_buckets(br.evidence_plan(br.bucket_scores(units)), units.select("project_id").distinct())


@query(
    "overview_intro_units",
    f"""SELECT project_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT {q.m(_LP, dims.README_ANYWHERE)}, start_line, file_path, id) AS rank
      FROM tree_units WHERE {q.m(_LP, dims.OVERVIEW_DOC)}) WHERE rank <= 2""",
)
def _(spark, sf):
    return br.overview_intro(_units(spark, sf)).select("project_id", "id", "rank")


_ST = "CASE section " + " ".join(f"WHEN {q.s(s)} THEN {q.arr(br.section_terms(s))}" for s in _SECTIONS) + " END"


@query(
    "section_evidence_select",
    f"""SELECT project_id, section, id, score, tokens, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY score DESC, tokens, ord) AS rank FROM (
      SELECT e.project_id, e.section, e.id, e.ord, {tokens_sql('u.code')} AS tokens, (coalesce(list_sum(list_transform({_ST.replace('section', 'e.section', 1)}, lambda t: CASE WHEN contains(lower(u.name), t) THEN 5 ELSE 0 END
        + CASE WHEN contains(lower(u.file_path), t) THEN 4 ELSE 0 END + CASE WHEN len(list_filter(u.exported_names, lambda x: contains(lower(x), t))) > 0 THEN 3 ELSE 0 END
        + CASE WHEN contains(lower(u.code), t) THEN 1 ELSE 0 END)), 0) + CASE WHEN {q.m('lower(u.file_path)', dims.OVERVIEW_DOC)} THEN 2 ELSE 0 END
        + CASE WHEN list_contains({buckets_sql('u.file_path')}, 'workflow_jobs') THEN 2 ELSE 0 END)::BIGINT AS score
      FROM v_evidence_plan e JOIN tree_units u ON u.project_id = e.project_id AND u.id = e.id)) WHERE rank <= {dims.SECTION_EVIDENCE_LIMIT}""",
)
def _(spark, sf):
    return br.section_evidence(_plan(spark, sf), _units(spark, sf)).drop("ord")


# --- central files, signals, lifecycle, workflows -----------------------------------------------------------

_CC = {"path": "file_path", "path_lower": "lp", "wtext": "wt"}
_FIXED = [(f"CASE WHEN {q.holds(c, _CC)} THEN {p} ELSE 0 END", r) for p, r, c in dims.CENTRAL_RULES]
_CT = (
    [("16", "file-level module anchor")]
    + _FIXED[:2]
    + [
        ("least(36, len(imports) * 6)", "imports other project code or dependencies"),
        ("least(24, len(exported_names) * 4)", "exports reusable symbols"),
        ("least(40, len(called_functions) * 3)", "coordinates function calls"),
    ]
    + _FIXED[2:]
)
_CR = "[" + ", ".join(f"({{'o': -({p}), 'i': {i}, 'r': {q.s(r)}}})" for i, (p, r) in enumerate(_CT)) + "]"
views.register(
    "v_central",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, file_path, start_line, id) AS rank FROM (
      SELECT project_id, id, file_path, start_line, {' + '.join(p for p, _ in _CT)} AS score,
        array_to_string(list_transform(list_slice(list_sort(list_filter({_CR}, lambda x: x.o < 0)), 1, 4), lambda x: x.r), '|') AS reasons FROM v_usable WHERE kind = 'module') WHERE score > 0) WHERE rank <= 12""",
)


@query("central_files", "SELECT project_id, id, file_path, score, reasons, rank FROM v_central")
def _(spark, sf):
    out = br.central_files(_units(spark, sf)).withColumn("reasons", F.array_join("reasons", "|"))
    return out.select("project_id", "id", "file_path", "score", "reasons", "rank")


_GS = " UNION ALL ".join(
    f"SELECT project_id, id, file_path, start_line, {q.s(n)} AS signal, CASE WHEN {q.m('wt', t)} THEN 50 ELSE 0 END + CASE WHEN {q.m('lp', p)} THEN 25 ELSE 0 END"
    " + least(18, len(called_functions) * 2) + least(12, len(imports) * 2) AS score FROM v_usable WHERE kind = 'module'"
    for n, t, p in dims.GROUNDING_SIGNALS
)


@query(
    "grounding_signals",
    f"""SELECT project_id, signal, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id, signal ORDER BY score DESC, file_path, start_line, id) AS rank FROM ({_GS}) WHERE score > 0) WHERE rank <= 5""",
)
def _(spark, sf):
    return br.grounding_signals(_units(spark, sf)).select("project_id", "signal", "id", "score", "rank")


def _n(lst, expr):
    return f"len(list_filter({lst}, lambda t: {expr}))"


_LC = " UNION ALL ".join(
    f"""SELECT project_id, id, file_path, start_line, {i} AS rule, {q.s(label)} AS label, {most} AS most, {_n(q.arr(pt), 'contains(lp, t)')} * 22 + least(6, {_n(q.arr(ct), 'contains(wt, t)')}) * 5
      + {_n(q.arr(bs), 'list_contains(buckets, t)')} * 16 + {q.points(dims.LIFECYCLE_PATHS, {'path_lower': 'lp'})} + CASE WHEN kind = 'module' THEN 8 ELSE 0 END
      + {f"CASE WHEN {q.m('lp', dims.LIFECYCLE_MODEL_PATH)} THEN 10 ELSE 0 END" if 'data_model' in bs else '0'} AS score FROM v_usable"""
    for i, (label, most, pt, ct, bs) in enumerate(dims.LIFECYCLE_RULES)
)
views.register(
    "v_lifecycle",
    f"""SELECT project_id, id, file_path, label, score, row_number() OVER (PARTITION BY project_id ORDER BY rule, rank) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY rule) AS nth FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY score DESC, file_path, start_line, id) AS rank FROM ({_LC}) WHERE score > 0) WHERE rank <= most) WHERE nth = 1""",
)


@query("lifecycle_evidence", "SELECT * FROM v_lifecycle")
def _(spark, sf):
    return br.lifecycle_evidence(_units(spark, sf))


_LAYER = "CASE " + " ".join(f"WHEN list_contains(buckets, {q.s(b)}) THEN {q.s(x)}" for b, x in dims.LAYERS) + " ELSE 'support' END"
_WF = " UNION ALL ".join(
    f"""SELECT project_id, id, file_path, start_line, {_LAYER} AS layer, {q.s(wid)} AS workflow, {q.s(title)} AS title, {_n(q.arr(bs), 'list_contains(buckets, t)')} * 18
      + {' + '.join(f"CASE WHEN {q.m('lp', p)} THEN 22 ELSE 0 END" for p in pats)} + {_n(q.arr(terms), 'contains(lp, t)')} * 12 + {_n(q.arr(terms), 'contains(ln, t)')} * 8 + {_n(q.arr(terms), 'contains(wt, t)')} * 2
      + len(list_filter(ents, lambda e: len(list_filter({q.arr(core)}, lambda c: contains(e, c))) > 0 AND (contains(lp, e) OR contains(wt, e)))) * 12
      + CASE WHEN kind = 'module' THEN 4 ELSE 0 END + CASE WHEN {q.m('lp', dims.README_FILE)} THEN 5 ELSE 0 END
      {"" if wid == 'viewer-analytics' else f"- CASE WHEN {q.m('lp', '/export-[^/]+')} THEN 30 ELSE 0 END"} AS score FROM v_with_entities"""
    for wid, title, terms, pats, bs, core in dims.WORKFLOWS
)
views.register(
    "v_with_entities",
    "SELECT u.*, coalesce(e.ents, CAST([] AS VARCHAR[])) AS ents FROM v_usable u LEFT JOIN (SELECT project_id, list(lower(entity)) AS ents FROM v_entities GROUP BY project_id) e USING (project_id)",
)
views.register("v_workflow_scores", f"SELECT * FROM ({_WF}) WHERE score > 12")
views.register(
    "v_workflow_evidence",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, workflow ORDER BY score DESC, file_path, start_line, id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, workflow, file_path ORDER BY score DESC, start_line, id) AS rn FROM v_workflow_scores) WHERE rn = 1) WHERE rank <= 6""",
)
_BONUS = " + ".join(
    f"CASE WHEN workflow = {q.s(w)} THEN CASE WHEN {q.m('words', p)} THEN {h} ELSE {m} END ELSE 0 END" for w, p, h, m in dims.PRIORITY_RULES
)
views.register(
    "v_traces",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, title) AS rank FROM (
      SELECT s.project_id, s.workflow, s.title, (strength + {_BONUS.replace('workflow =', 's.workflow =')})::BIGINT AS priority, n_evidence, layers FROM (
        SELECT project_id, workflow, title, sum(score) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY project_id, workflow ORDER BY score DESC, file_path, start_line, id) AS rn FROM v_workflow_scores) WHERE rn <= 8 GROUP BY ALL) s
      JOIN (SELECT project_id, workflow, count(*) AS n_evidence, array_to_string(list_sort(list(DISTINCT layer)), '|') AS layers FROM v_workflow_evidence GROUP BY ALL) e USING (project_id, workflow)
      LEFT JOIN (SELECT project_id, lower(string_agg(signal, ' ')) AS words FROM v_product GROUP BY project_id) p USING (project_id)) WHERE n_evidence >= 2 AND priority > 25) WHERE rank <= 6""",
)


def _workflows(spark, sf):
    units = _units(spark, sf)
    # Ids and scores only: written once, so that the text is read once for each of the two.
    entities = shared(spark, sf, "entities", lambda: br.domain_entities(units))
    scored = shared(spark, sf, "workflow-scores", lambda: br.workflow_scores(units, entities))
    return units, entities, scored, br.workflow_traces(scored, br.product_signals(units, entities))


@query("workflow_traces", "SELECT * FROM v_traces")
def _(spark, sf):
    return _workflows(spark, sf)[3].withColumn("layers", F.array_join("layers", "|"))


@query("workflow_evidence", "SELECT project_id, workflow, id, layer, score, rank FROM v_workflow_evidence")
def _(spark, sf):
    _, _, scored, _ = _workflows(spark, sf)
    return br.workflow_evidence(scored).select("project_id", "workflow", "id", "layer", "score", "rank")


views.register(
    "v_central_evidence",
    f"""SELECT * FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY first_at, id) AS pos FROM (SELECT project_id, id, min((tier, place)) AS first_at FROM (
      SELECT project_id, id, 0 AS tier, rank AS place FROM v_central UNION ALL
      SELECT project_id, id, 1, row_number() OVER (PARTITION BY project_id ORDER BY file_path, start_line, id) FROM v_usable WHERE {q.m('lp', r'^readme\.mdx?$|^package\.json$')} UNION ALL
      SELECT project_id, id, 2, pos FROM v_lifecycle UNION ALL SELECT project_id, id, 3, rank FROM v_entities UNION ALL
      SELECT e.project_id, e.id, 4, t.rank * 1000 + e.rank FROM v_workflow_evidence e JOIN v_traces t USING (project_id, workflow)) GROUP BY ALL)) WHERE pos <= 36""",
)


def _central(spark, sf):
    units, entities, scored, traces = _workflows(spark, sf)
    return br.central_evidence(br.central_files(units), units, br.lifecycle_evidence(units), entities, scored, traces)


@query("central_evidence", "SELECT * FROM v_central_evidence")
def _(spark, sf):
    return _central(spark, sf)


# --- sections -------------------------------------------------------------------------------------------------

_ROLES = list(dims.AUDIENCE_PLANS)
_ROWS = "(VALUES " + ", ".join(
    f"({q.s(role)}, {i + 1}, {q.s(s)}, {q.s(br.HINTS[s])}, {q.s(next(k for n, _, k in dims.SECTIONS if n == s))}, {q.s('|'.join(br.section_terms(s)))})"
    for role, plan in dims.AUDIENCE_PLANS.items()
    for i, part in enumerate(plan)
    for s in part
) + ") AS p(role, part, section, hint, fallback_kind, terms)"


@query(
    "section_queries",
    f"SELECT session_id, role, part, section, hint, fallback_kind, terms FROM (SELECT session_id, {q.arr(_ROLES)}[session_id % {len(_ROLES)} + 1] AS role FROM sessions) JOIN {_ROWS} USING (role)",
)
def _(spark, sf):
    roles = F.array(*[F.lit(r) for r in _ROLES])
    s = corpus.sessions(spark, sf).select("session_id", F.get(roles, (F.col("session_id") % len(_ROLES)).cast("int")).alias("role"))
    return br.section_queries(s).withColumn("terms", F.array_join("terms", "|"))


_BT = "lower(concat_ws(chr(10), file_path, name, kind, coalesce(docstring, ''), array_to_string(exported_names, ' '), array_to_string(called_functions, ' '), code))"
_TP = " + ".join(
    f"CASE WHEN contains(lp, {q.s(t)}) OR contains(lower(name), {q.s(t)}) THEN 10 WHEN contains(bt, {q.s(t)}) THEN 3 ELSE 0 END" for t in dims.BRIEFING_WORKFLOW_TERMS
)
_LEN = f"""CASE WHEN {_DOC} AND {q.m('lp', dims.README_ANYWHERE)} THEN 0 WHEN {_DOC} AND nl > 1000 THEN -30 WHEN nl > 1200 THEN -32 WHEN nl > 600 THEN -20 WHEN nl > 300 THEN -8 ELSE 0 END"""
_STATIC = f"""CASE WHEN {q.m('file_path', dims.TEST_FILE)} THEN -30 ELSE 0 END + CASE WHEN {_DOC} THEN CASE WHEN {q.m('lp', r'^readme\.md$')} THEN 44 ELSE 24 END ELSE 0 END
  + CASE WHEN {q.m('file_path', dims.PACKAGE_BOUNDARY)} THEN 22 ELSE 0 END + CASE WHEN {q.m('lp', r'^(src|app|apps|packages)/')} THEN 8 ELSE 0 END
  + CASE WHEN kind = 'module' THEN 5 WHEN kind IN ('class', 'function') THEN 3 ELSE 0 END + {_TP} + {_LEN}"""
_COND = " + ".join(f"CASE WHEN {q.m('sq', asked)} AND {q.m('bt', words)} THEN {p} ELSE 0 END" for p, asked, words in dims.BRIEFING_RULES)
_PT = " + ".join(f"CASE WHEN contains(sq, {q.s(t)}) AND contains(bt, {q.s(t)}) THEN 4 ELSE 0 END" for t in dims.BRIEFING_PRODUCT_TERMS)
_SQ = "(VALUES " + ", ".join(f"({q.s(s)}, {q.s(br.section_query(s).lower())})" for s in _SECTIONS) + ") AS sec(section, sq)"
views.register(
    "v_briefing_hits",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY score DESC, file_path, start_line, id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, section, file_path ORDER BY score DESC, start_line, id) AS in_file FROM (
        SELECT project_id, section, id, file_path, start_line, {_STATIC} + {_PT} + {_COND} + CASE WHEN {q.m('lp', dims.CHANGELOG_FILE)} AND NOT {q.m('sq', dims.CHANGELOG_QUERY)} THEN -55 ELSE 0 END AS score
        FROM (SELECT *, {_LP} AS lp, {_BT} AS bt, end_line - start_line + 1 AS nl FROM tree_units WHERE NOT is_vendored AND NOT {q.m(_LP, dims.NOISE_FILE)}), {_SQ}) WHERE score > 0) WHERE in_file <= 3) WHERE rank <= 24""",
)


@query("briefing_retrieval", "SELECT project_id, section, id, file_path, score, rank FROM v_briefing_hits")
def _(spark, sf):
    return br.briefing_hits(_units(spark, sf), _SECTIONS).select("project_id", "section", "id", "file_path", "score", "rank")


_BR_ON = {"low": "lp", "path_name": "lower(concat_ws(' ', file_path, name))", "text": "bt"}
_BR = " + ".join(f"CASE WHEN {q.m('sq', asked)} AND m{i} THEN {p} ELSE 0 END" for i, (p, asked, _, _, _) in enumerate(dims.BRIEFING_QUERY_RULES))
_BR_WHY = [f"CASE WHEN {q.m('sq', asked)} AND m{i} THEN {q.s(r)} END" for i, (_, asked, _, _, r) in enumerate(dims.BRIEFING_QUERY_RULES)]
_BR_ALWAYS = [
    f"CASE WHEN {_DOC} THEN 'overview documentation' END", f"CASE WHEN {q.m('file_path', dims.PACKAGE_BOUNDARY)} THEN 'package or app boundary' END",
    f"CASE WHEN {q.m('lp', r'^(src|app|apps|packages)/')} THEN 'production source' END", "CASE WHEN kind = 'module' THEN 'file-level context' END",
    *[f"CASE WHEN contains(lp, {q.s(t)}) OR contains(lower(name), {q.s(t)}) THEN {q.s('workflow term in path/name: ' + t)} END" for t in dims.BRIEFING_WORKFLOW_TERMS],
]
views.register(
    "v_briefing_facts",
    f"""SELECT project_id, id, file_path, start_line, bt, {_STATIC} AS static, {q.m('lp', dims.CHANGELOG_FILE)} AS changelog, {', '.join(f"{q.m(_BR_ON[on], words)} AS m{i}" for i, (_, _, on, words, _) in enumerate(dims.BRIEFING_QUERY_RULES))}, {q.compact(_BR_ALWAYS)} AS always
      FROM (SELECT *, {_LP} AS lp, {_BT} AS bt, end_line - start_line + 1 AS nl FROM tree_units WHERE NOT is_vendored AND NOT {q.m(_LP, dims.NOISE_FILE)})""",
)


@query(
    "briefing_search",
    f"""SELECT query_id, project_id, id, file_path, score, rank, reasons FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, start_line, id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, start_line, id) AS n FROM (
        SELECT q.query_id, q.project_id, q.k, q.per_file, f.id, f.file_path, f.start_line, static + {_PT} + {_BR} + CASE WHEN changelog AND NOT {q.m('sq', dims.CHANGELOG_QUERY)} THEN -55 ELSE 0 END AS score,
          array_to_string(always || {q.compact(_BR_WHY)}, '|') AS reasons FROM (SELECT *, lower(query) AS sq, CASE WHEN starts_with(query_id, 'g') THEN 24 ELSE 8 END AS k, CASE WHEN starts_with(query_id, 'g') THEN 3 ELSE 2 END AS per_file FROM queries) q
        JOIN v_briefing_facts f USING (project_id)) WHERE score > 0) WHERE n <= per_file) WHERE rank <= k""",
)
def _(spark, sf):
    golden = F.startswith("query_id", F.lit("g"))
    asked = corpus.queries(spark, sf).withColumns({"k": F.when(golden, 24).otherwise(8), "per_file": F.when(golden, 3).otherwise(2)})
    return br.briefing_search(_units(spark, sf), asked).withColumn("reasons", F.array_join("reasons", "|"))


# The context of a section is filled from planned units, then from the briefing hits.
BUDGET = 1440
views.register(
    "v_section_candidates",
    """SELECT project_id, section, id, row_number() OVER (PARTITION BY project_id, section ORDER BY first_at, id) AS ord FROM (
      SELECT project_id, section, id, min((tier, place)) AS first_at FROM (SELECT project_id, section, id, 0 AS tier, ord AS place FROM v_evidence_plan UNION ALL
        SELECT project_id, section, id, 1, rank FROM v_briefing_hits) GROUP BY ALL)""",
)
views.register(
    "v_section_seq",
    f"""SELECT *, concat(project_id, ':', section) AS g, row_number() OVER (PARTITION BY project_id, section ORDER BY CASE WHEN o AND orank <= 2 THEN 0 WHEN b AND brank <= 2 THEN 1 ELSE 2 END, ord) AS step FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, section, o ORDER BY ord) AS orank, row_number() OVER (PARTITION BY project_id, section, b ORDER BY ord) AS brank FROM (
        SELECT project_id, section, id, file_path, ord, cut_start AS start_line, cut_end AS end_line, {tokens_sql('cut_code')} AS tokens, {q.m(_LP, dims.OVERVIEW_DOC)} AS o, list_contains({buckets_sql()}, 'overview_docs') AS b FROM (
          {truncate_sql("SELECT c.section, c.ord, u.* FROM v_section_candidates c JOIN tree_units u ON u.project_id = c.project_id AND u.id = c.id",
            f"CAST(floor({BUDGET} * CASE WHEN section = 'Top User Workflows' THEN 0.12::DOUBLE ELSE 0.18::DOUBLE END) AS INTEGER)", "CAST([] AS VARCHAR[])", "project_id, section, id, file_path, ord")})))""",
)
views.register(
    "v_section_context",
    f"""WITH RECURSIVE walk AS (SELECT g, step, tokens <= {BUDGET} AS kept, CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS total FROM v_section_seq WHERE step = 1
      UNION ALL SELECT w.g, s.step, w.total + s.tokens <= {BUDGET}, w.total + CASE WHEN w.total + s.tokens <= {BUDGET} THEN s.tokens ELSE 0 END FROM walk w JOIN v_section_seq s ON s.g = w.g AND s.step = w.step + 1)
      SELECT s.*, row_number() OVER (PARTITION BY s.g ORDER BY s.step) AS slot FROM v_section_seq s JOIN walk w ON w.g = s.g AND w.step = s.step WHERE w.kept""",
)


@query("select_briefing_context", "SELECT project_id, section, id, file_path, start_line, end_line, tokens, slot FROM v_section_context")
def _(spark, sf):
    from pyspark.sql import Window

    units = _units(spark, sf)
    planned = _plan(spark, sf).select("project_id", "section", "id", F.lit(0).alias("tier"), F.col("ord").alias("place"))
    hits = br.briefing_hits(units, _SECTIONS).select("project_id", "section", "id", F.lit(1).alias("tier"), F.col("rank").alias("place"))
    first = planned.unionByName(hits).groupBy("project_id", "section", "id").agg(F.min(F.struct("tier", "place", "id")).alias("at"))
    w = Window.partitionBy("project_id", "section").orderBy("at")
    return br.select_context(first.withColumn("ord", F.row_number().over(w)).drop("at"), units, BUDGET)
