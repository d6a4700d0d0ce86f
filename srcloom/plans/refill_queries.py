"""Registered queries that complete a briefing: wanted sections, refilled sections, units of section sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import paths, sections
from srcloom.operators import briefing as br
from srcloom.operators import citations as cit
from srcloom.operators import refill
from srcloom.plans import briefing_queries as bq
from srcloom.plans.citation_queries import squeeze_sql
from srcloom.plans.followup_queries import _SEC, _WEAK, _WHOLE, overview_sql
from srcloom.plans.text_queries import buckets_sql
from srcloom.registry import query
from srcloom.sources import corpus

_ROLES = list(dims.AUDIENCE_PLANS)
_FLAT = {role: [s for part in plan for s in part] for role, plan in dims.AUDIENCE_PLANS.items()}


def _wanted(role):
    out = F.array().cast("array<string>")
    for name, names in _FLAT.items():
        out = F.when(role == name, paths.strings(names)).otherwise(out)
    return out


def _briefs(spark, sf):
    """Answers as briefings of an audience, with the sections that this audience wants."""
    role = F.get(paths.strings(_ROLES), (F.col("answer_id") % len(_ROLES)).cast("int"))
    return corpus.answers(spark, sf).select("answer_id", "project_id", "answer", _wanted(role).alias("sections"))


# --- wanted sections of a cut-off briefing ------------------------------------------------------------

_PLAN = "(VALUES " + ", ".join(f"({i}, {k + 1}, {q.s(s)})" for i, r in enumerate(_ROLES) for k, s in enumerate(_FLAT[r])) + ") AS p(slot, i, section)"
views.register("v_wanted", f"SELECT answer_id, project_id, i, section FROM answers JOIN {_PLAN} ON slot = answer_id % {len(_ROLES)}")
views.register(
    "v_first_section",
    f"""SELECT answer_id, lower({q.trim("regexp_extract(c, '^###[ \\t]+([^\\n]*)', 1)")}) AS low, arg_min(regexp_replace(c, '^[^\\n]*\\n?', ''), i) AS body
      FROM (SELECT answer_id, i, cs[i] AS c FROM (SELECT answer_id, {_SEC} AS cs FROM answers), range(1, len(cs) + 1) r(i)) GROUP BY ALL""",
)
views.register(
    "v_sanitized",
    f"""SELECT answer_id, project_id, string_agg(concat('### ', section, chr(10), CASE WHEN coalesce(tail, '') = '' THEN {q.s(dims.NOT_FOUND)} ELSE tail END), chr(10) || chr(10) ORDER BY i) AS text FROM (
      SELECT *, {q.trim(f"array_to_string(list_slice(ls, 1, coalesce(list_max(list_transform(ls, lambda l, j: CASE WHEN {_WHOLE} THEN j ELSE 0 END)), 0)), chr(10))")} AS tail FROM (
        SELECT w.*, string_split({q.trim('body')}, chr(10)) AS ls FROM v_wanted w LEFT JOIN v_first_section f ON f.answer_id = w.answer_id AND f.low = lower(w.section))) GROUP BY ALL""",
)


@query("sanitize_sections", "SELECT answer_id, text FROM v_sanitized")
def _(spark, sf):
    return _briefs(spark, sf).select("answer_id", sections.sanitize(F.col("answer"), F.col("sections")).alias("text"))


# --- refilled sections ----------------------------------------------------------------------------------


def _context(spark, sf):
    """Units of a project as the context of its briefings; only overview documents bring their text."""
    units = corpus.units(spark, sf)
    code = F.when(paths.is_overview_doc(F.col("file_path")), F.col("code"))
    order = Window.partitionBy("context_id").orderBy("file_path", "start_line", "id")
    heads = units.select(F.col("project_id").alias("context_id"), "id", "file_path", "start_line", "end_line", code.alias("code"))
    return heads.withColumn("ord", F.row_number().over(order))


views.register(
    "v_unit_order",
    f"SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, start_line, id) AS ord, concat('[', file_path, ':', start_line, '-', end_line, ']') AS cite, {buckets_sql()} AS buckets FROM units",
)


def _slot(name):
    hit = " OR ".join(f"list_contains(buckets, {q.s(b)})" for b in dims.EVIDENCE_SLOTS[name])
    return f"arg_min({{'id': id, 'c': cite}}, CASE WHEN {hit} THEN ord END) AS {name}"


def _group(slots):
    members = "list_filter([" + ", ".join([*slots, "first_unit"]) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string(list_transform(list_slice({q.distinct(members)}, 1, 3), lambda x: x.c), ' ')"


_CLS = " ".join(f"UNION ALL SELECT *, {q.s(c)} AS class FROM v_cited_nodes WHERE type IN ({', '.join(q.s(t) for t in types)})" for c, types in dims.GRAPH_CLASSES.items())
views.register(
    "v_cited_nodes",
    f"""SELECT n.project_id, CAST(substr(n.node_id, 2) AS BIGINT) AS ord, n.type, n.label, {q.trim("regexp_replace(n.summary, '(?i)\\s+Evidence:\\s+[^\\n\\r]*\\z', '', 'g')")} AS summary, c.citation FROM kg_nodes n JOIN (
      SELECT project_id, owner_id, arg_min(CASE WHEN inside THEN concat('[', file_path, ':', start_line, '-', end_line, ']') ELSE cite END, (sord, CASE WHEN inside THEN 0 ELSE 1 END, uord)) AS citation FROM (
        SELECT s.project_id, s.owner_id, s.ord AS sord, s.file_path, s.start_line, s.end_line, u.cite, u.ord AS uord, s.start_line >= u.start_line AND s.end_line <= u.end_line AS inside
        FROM kg_sources s JOIN v_unit_order u ON u.project_id = s.project_id AND u.file_path = s.file_path
          AND ((u.start_line <= s.end_line AND u.end_line >= s.start_line) OR (s.start_line >= u.start_line AND s.end_line <= u.end_line))) GROUP BY ALL) c
      ON c.project_id = n.project_id AND c.owner_id = n.node_id WHERE n.type IN ({', '.join(q.s(t) for t in dims.NODE_TYPES)})""",
)
views.register(
    "v_graph_facts",
    f"""SELECT project_id, {', '.join(f"coalesce(list({{'l': label, 's': summary, 'c': citation}} ORDER BY ord) FILTER (WHERE class = {q.s(c)} AND rank <= {refill.MOST_NODES}), []) AS c_{c}" for c in ['all', *dims.GRAPH_CLASSES])} FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, class ORDER BY ord) AS rank FROM (SELECT *, 'all' AS class FROM v_cited_nodes {_CLS})) GROUP BY project_id""",
)
_SAID = f"regexp_replace({q.trim(q.rep('statement', r'\s+', ' '))}, '[.!?]\\s*\\z', '')"
views.register("v_overview_units", overview_sql("units"))
views.register(
    "v_facts",
    f"""SELECT e.*, g.* EXCLUDE (project_id), CASE WHEN o.statement IS NOT NULL THEN concat(upper(left({_SAID}, 1)), substr({_SAID}, 2)) END AS overview, o.citation AS overview_citation FROM (
      SELECT project_id, {', '.join(f'{_group(slots)} AS cite_{name}' for name, slots in dims.CITED_SLOTS.items())} FROM (
        SELECT project_id, {', '.join(map(_slot, dims.EVIDENCE_SLOTS))}, arg_min({{'id': id, 'c': cite}}, ord) AS first_unit FROM v_unit_order GROUP BY project_id)) e
      LEFT JOIN v_graph_facts g USING (project_id) LEFT JOIN v_overview_units o USING (project_id)""",
)


def _prefer(classes):
    out = f"c_{classes[-1]}"
    for c in reversed(classes[:-1]):
        out = f"CASE WHEN len(c_{c}) > 0 THEN c_{c} ELSE {out} END"
    return f"({out})"


def _graph_case():
    primary = f"list_slice({_prefer(['system', 'all'])}, 1, 3)"
    labels = f"array_to_string(list_transform({primary}, lambda x: x.l), ', ')"
    cites = f"array_to_string(list_transform({primary}, lambda x: x.c), ' ')"
    out = []
    for kind, classes, most, form, sentence in dims.GRAPH_FALLBACKS:
        filled = f"replace(replace({q.s(sentence)}, '{{labels}}', {labels}), '{{citations}}', {cites})" if sentence else "NULL"
        text = filled
        if classes:
            mark = "concat(n, '. ')" if form.startswith("#") else q.s(form)
            lines = f"list_transform(list_slice({_prefer(classes)}, 1, {most}), lambda x, n: concat({mark}, '**', x.l, '**: ', x.s, ' ', x.c, '.'))"
            text = f"coalesce(nullif(array_to_string({lines}, chr(10)), ''), {filled})"
        out.append(f"WHEN {q.s(kind)} THEN {text}")
    return "CASE WHEN len(c_all) > 0 THEN CASE kind " + " ".join(out) + " END END"


def _evidence_case():
    group, text = dims.OTHER_EVIDENCE_FALLBACK
    plain = "CASE kind " + " ".join(f"WHEN {q.s(k)} THEN concat({q.s(t)}, ' ', cite_{g}, '.')" for k, (g, t) in dims.EVIDENCE_FALLBACKS.items())
    plain += f" ELSE concat({q.s(text)}, ' ', cite_{group}, '.') END"
    note = "CASE section " + " ".join(f"WHEN {q.s(k)} THEN concat({q.s(t)}, ' ', cite_core, '.')" for k, t in dims.SECTION_NOTES.items()) + " END"
    said = "CASE WHEN overview IS NOT NULL THEN CASE kind " + " ".join(
        f"WHEN {q.s(k)} THEN concat({q.s(t)}, overview, ' ', overview_citation, '.')" for k, t in dims.OVERVIEW_FALLBACKS.items()
    ) + " END END"
    return f"coalesce({said}, {note}, {plain})"


_HEAD = "## Briefing\n\n"
_FP = q.trim("regexp_split_to_array(trimmed, chr(10) || '{2,}')[1]")
views.register(
    "v_brief_parts",
    f"""SELECT answer_id, project_id, i, c, section, kind, trimmed, {_FP} AS fp FROM (SELECT *, {q.lit_map('section', refill.KINDS, 'section')} AS kind, {q.trim("regexp_replace(c, '^[^\\n]*\\n?', '')")} AS trimmed FROM (
      SELECT b.answer_id, b.project_id, b.i, b.c, CASE WHEN row_number() OVER (PARTITION BY b.answer_id, low ORDER BY b.i) = 1 THEN w.section END AS section FROM (
        SELECT *, lower({q.trim("regexp_extract(c, '^###[ \\t]+([^\\n]*)', 1)")}) AS low FROM (SELECT answer_id, project_id, i, cs[i] AS c FROM (
          SELECT *, string_split(regexp_replace(concat(chr(10), {q.s(_HEAD)}, text), '\\n(###[ \\t]+)', chr(1) || '\\1', 'g'), chr(1)) AS cs FROM v_sanitized), range(1, len(cs) + 1) r(i))) b
      LEFT JOIN v_wanted w ON w.answer_id = b.answer_id AND lower(w.section) = b.low))""",
)
views.register(
    "v_refilled",
    f"""SELECT answer_id, project_id, string_agg(part, chr(10) ORDER BY i) AS text FROM (
      SELECT p.answer_id, p.project_id, i, CASE WHEN section IS NULL OR NOT (trimmed = '' OR {q.m('trimmed', r'^not found in provided context\.?$', 'i')} OR (kind = 'Product In One Paragraph' AND {_WEAK})
          OR (NOT list_contains({q.arr(cit.SYNTHESIS_SECTIONS)}, section) AND NOT {q.m('trimmed', dims.CITED)})) THEN c
        ELSE concat({q.ex("concat(c, chr(10))", refill._HEADING)}, coalesce({_graph_case()}, {_evidence_case()}), chr(10)) END AS part
      FROM v_brief_parts p LEFT JOIN v_facts USING (project_id)) GROUP BY ALL""",
)


@query(
    "backfill_sections",
    f"""SELECT r.answer_id AS brief_id, CASE WHEN f.project_id IS NULL THEN concat({q.s(_HEAD)}, s.text) ELSE {squeeze_sql("substr(r.text, 2)")} END AS text
      FROM v_refilled r JOIN v_sanitized s USING (answer_id) LEFT JOIN v_facts f ON f.project_id = r.project_id""",
)
def _(spark, sf):
    sanitized = F.concat(F.lit(_HEAD), sections.sanitize(F.col("answer"), F.col("sections")))
    briefs = _briefs(spark, sf).select(
        F.col("answer_id").alias("brief_id"), F.col("project_id").alias("context_id"), sanitized.alias("text"), "sections"
    )
    nodes = corpus.kg_nodes(spark, sf).filter(F.col("type").isin(dims.NODE_TYPES)).withColumnRenamed("project_id", "context_id")
    nodes = nodes.withColumn("ord", F.substring("node_id", 2, 20).cast("long"))
    sources = corpus.kg_sources(spark, sf).withColumnRenamed("project_id", "context_id")
    return refill.backfill_sections(briefs, _context(spark, sf), nodes, sources).select("brief_id", "text")


# --- workflow units of section sets ----------------------------------------------------------------------

_PARTS = [(role, i + 1, part) for role, plan in dims.AUDIENCE_PLANS.items() for i, part in enumerate(plan)]


def _overlap(col, buckets):
    return "(" + " OR ".join(f"list_contains({col}, {q.s(b)})" for b in buckets) + ")"


def _request_sql():
    rows = ", ".join(f"({q.s(role)}, {i}, {q.arr(part)}, {q.s(' '.join(part).lower())})" for role, i, part in _PARTS)
    return f"""SELECT concat(project_id, ':', role, ':', i) AS request_id, project_id, list_contains(sections, 'Top User Workflows') AS top, {q.m('joined', dims.WORKFLOW_SECTION)} OR {q.m('joined', dims.REFILL_PRODUCT_SECTION)} AS any_workflow,
      {q.m('joined', dims.RISK_SECTION)} AS risky FROM (SELECT DISTINCT project_id FROM tree_units), (VALUES {rows}) p(role, i, sections, joined)"""


views.register("v_section_requests", _request_sql())
views.register("v_head", f"SELECT project_id, id, file_path, {buckets_sql()} AS buckets FROM tree_units")
views.register(
    "v_workflow_kinds",
    f"""SELECT project_id, workflow, at_risk, apart AND project_id IN (SELECT project_id FROM v_lifecycle) AS aside FROM (SELECT e.project_id, workflow, bool_or({_overlap('buckets', dims.RISK_BUCKETS)}) AS at_risk, bool_or({_overlap('buckets', dims.SECONDARY_BUCKETS)}) AND NOT bool_or({_overlap('buckets', dims.PRIMARY_BUCKETS)}) AS apart FROM (
      SELECT e.project_id, e.workflow, h.buckets FROM v_workflow_evidence e JOIN v_head h USING (project_id, id)) e GROUP BY ALL)""",
)
views.register(
    "v_flows",
    """SELECT e.project_id, e.id, e.file_path, k.at_risk, k.aside, t.rank AS wrank, e.rank AS place FROM v_workflow_evidence e JOIN v_traces t USING (project_id, workflow) JOIN v_workflow_kinds k USING (project_id, workflow)""",
)


@query(
    "section_workflow_units",
    """SELECT request_id, project_id, id, row_number() OVER (PARTITION BY request_id ORDER BY spot, id) AS pos FROM (
      SELECT request_id, project_id, id, min(spot) AS spot FROM (
        SELECT r.request_id, r.project_id, l.id, (0, 0, l.pos::BIGINT, 0::BIGINT) AS spot FROM v_section_requests r JOIN v_lifecycle l USING (project_id) WHERE r.top
        UNION ALL SELECT r.request_id, r.project_id, c.id, (0, 0, c.pos::BIGINT, 0::BIGINT) FROM v_section_requests r JOIN v_central_evidence c USING (project_id) WHERE NOT r.top AND c.pos <= 12
        UNION ALL SELECT r.request_id, r.project_id, f.id, (1, CASE WHEN r.top AND f.aside THEN 1 ELSE 0 END, f.wrank::BIGINT, f.place::BIGINT) FROM v_section_requests r JOIN v_flows f USING (project_id) WHERE r.any_workflow OR (r.risky AND f.at_risk)
        UNION ALL SELECT r.request_id, r.project_id, c.id, (2, 0, c.pos::BIGINT, 0::BIGINT) FROM v_section_requests r JOIN (
          SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS n FROM (SELECT c.*, h.file_path FROM v_central_evidence c JOIN v_head h USING (project_id, id))
          WHERE (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM v_flows WHERE aside)) c USING (project_id) WHERE r.top AND c.n <= 6) GROUP BY ALL)""",
)
def _(spark, sf):
    units, entities, scored, traces = bq._workflows(spark, sf)
    heads = units.select("project_id", "id", "file_path")
    life = br.lifecycle_evidence(units)
    central = br.central_evidence(br.central_files(units), units, life, entities, scored, traces).join(heads, ["project_id", "id"])
    plans = F.array(
        *[F.struct(F.lit(role).alias("role"), F.lit(i).alias("part"), paths.strings(part).alias("sections")) for role, i, part in _PARTS]
    )
    asked = units.select("project_id").distinct().select("project_id", F.explode(plans).alias("p"))
    requests = asked.select(
        F.concat_ws(":", F.col("project_id").cast("string"), "p.role", F.col("p.part").cast("string")).alias("request_id"), "project_id", "p.sections"
    )
    return br.section_workflow_units(requests, central, life, br.workflow_evidence(scored), traces)
