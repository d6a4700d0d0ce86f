"""Registered queries for briefing sections and follow-up questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import questions, sections
from srcloom.operators import citations as cit
from srcloom.operators import followup, history, retrieve
from srcloom.plans import answer
from srcloom.plans.citation_queries import context_units, judged, norm_sql, squeeze_sql
from srcloom.registry import query
from srcloom.sources import corpus
from srcloom.staging import shared, stage

A = "answer"
KINDS = {s: k for s, _, k in dims.SECTIONS}

# --- sections --------------------------------------------------------------------------------

_SEC = f"list_filter(string_split(regexp_replace(concat(chr(10), answer), '\\n(###[ \\t]+)', chr(1) || '\\1', 'g'), chr(1)), lambda c: {q.m('c', r'^###\s+')})"
_FIRST = q.trim("regexp_split_to_array(trimmed, chr(10) || '{2,}')[1]")
_WEAK = f"""CASE WHEN fp = '' THEN true WHEN {q.m('fp', dims.META_NOISE, 'i')} THEN true WHEN {q.m('fp', dims.CITED)} THEN false WHEN {q.m('fp', dims.DEFINITION_OPENER)} THEN false
  WHEN {q.m('fp', ':$')} AND length(fp) < 160 THEN true WHEN {q.m('fp', dims.WEAK_OPENER, 'i')} AND length(fp) < 140 THEN true ELSE length(fp) < 80 AND NOT {q.m('fp', '[.!?]$')} END"""


@query(
    "briefing_sections",
    f"""SELECT answer_id, title, body, trimmed = '' OR {q.m('trimmed', r'^not found in provided context\.?$', 'i')} OR (kind = 'Product In One Paragraph' AND {_WEAK})
        OR (NOT list_contains({q.arr(cit.SYNTHESIS_SECTIONS)}, title) AND NOT {q.m('trimmed', dims.CITED)}) AS needs_backfill FROM (
      SELECT *, {q.lit_map('title', KINDS, 'title')} AS kind, {_FIRST} AS fp FROM (SELECT *, {q.trim('body')} AS trimmed FROM (
        SELECT answer_id, {q.trim("regexp_extract(s, '^###[ \\t]+([^\\n]*)', 1)")} AS title, regexp_replace(s, '^[^\\n]*\\n?', '') AS body FROM (SELECT answer_id, unnest({_SEC}) AS s FROM answers))))""",
)
def _(spark, sf):
    from srcloom.functions.paths import lit_map

    rows = corpus.answers(spark, sf).select("answer_id", F.explode(sections.split_sections(F.col(A))).alias("s")).select("answer_id", "s.*")
    kind = F.coalesce(F.try_element_at(lit_map(KINDS), F.col("title")), F.col("title"))
    flag = sections.needs_backfill(
        F.col("body"), kind == "Product In One Paragraph", ~F.col("title").isin(cit.SYNTHESIS_SECTIONS)
    )
    return rows.withColumn("needs_backfill", flag)


_T = q.trim("l")
_WHOLE = f"({_T} <> '' AND NOT {q.m(_T, r'^[-*]\s*$')} AND NOT {q.m(_T, r'\[[^\]]*$')} AND {q.m(_T, dims.COMPLETE_LINE)})"


@query(
    "trim_incomplete_tail",
    f"""SELECT answer_id, {q.trim(f"array_to_string(list_slice(ls, 1, coalesce(list_max(list_transform(ls, lambda l, i: CASE WHEN {_WHOLE} THEN i ELSE 0 END)), 0)), chr(10))")} AS text
      FROM (SELECT answer_id, string_split({q.trim('answer')}, chr(10)) AS ls FROM answers)""",
)
def _(spark, sf):
    return corpus.answers(spark, sf).select("answer_id", sections.trim_incomplete_tail(F.col(A)).alias("text"))


views.register(
    "v_tidy_lines",
    f"""SELECT answer_id, i, line, {q.trim('line')} AS t, (SELECT 1) AS one FROM (SELECT answer_id, i, ls[i] AS line FROM (SELECT answer_id, string_split(answer, chr(10)) AS ls FROM answers), range(1, len(ls) + 1) r(i))""",
)
views.register(
    "v_tidy_kept",
    f"""SELECT answer_id, i, line, t, {q.m('line', dims.NUMBERED)} AS numbered, t = '' OR {q.m('line', r'^\s+\S')} AS neutral FROM (
      SELECT *, first_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM v_tidy_lines)
      WHERE NOT {q.m('t', dims.DROPPABLE_HEADING)} OR (nxt IS NOT NULL AND NOT {q.m('nxt', dims.ANY_HEADING)})""",
)


@query(
    "tidy_structure",
    f"""SELECT answer_id, {squeeze_sql("string_agg(CASE WHEN numbered THEN concat(" + q.ex('line', dims.NUMBERED, 1) + ", n, '.', " + q.ex('line', dims.NUMBERED, 3) + ", " + q.ex('line', dims.NUMBERED, 4) + ") ELSE line END, chr(10) ORDER BY i)")} AS text FROM (
      SELECT *, count(*) FILTER (WHERE numbered) OVER (PARTITION BY answer_id, island ORDER BY i) AS n FROM (
        SELECT *, count(*) FILTER (WHERE NOT numbered AND NOT neutral) OVER (PARTITION BY answer_id ORDER BY i) AS island FROM v_tidy_kept)) GROUP BY answer_id""",
)
def _(spark, sf):
    return corpus.answers(spark, sf).select("answer_id", sections.tidy(F.col(A)).alias("text"))


_CLEAN = "p"
for _pat, _by in ((r"(?s)```.*?```", " "), (r"<[^>]+>", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "\\1"), (r"[`*_>#]", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, {q.s(_pat)}, {q.s(_by)}, 'g')"
_CLEAN = q.trim(q.rep(q.rep(_CLEAN, r"(?:^|\s)-\s+", " "), r"\s+", " "))
_PTS = [
    (q.m("p", dims.DEFINITION_OPENER), 10), (q.m("p", r"^(?:a|an)\s+open[-\s]source\b", "i"), 8), (q.m("p", dims.TAGLINE, "i"), 6),
    (q.m("left(p, 160)", r"\b(?:is|are) (?:a|an|the)\b", "i"), 4), (q.m("p", r"^(?:the|a|an)\b", "i"), -2), (q.m("p", dims.META_NOISE, "i"), -10),
]
_SENT = "regexp_extract(p, '^([^\\n\\r]+?[.!?])(?:\\s|\\z)', 1)"


def overview_sql(source: str) -> str:
    return f"""SELECT project_id, id, CASE WHEN length({_SENT}) >= 40 THEN {_SENT} WHEN length(p) <= 260 THEN p ELSE concat(regexp_replace(regexp_replace(left(p, 260), '\\s+\\S*\\z', ''), '[,:;]\\s*\\z', ''), '.') END AS statement,
      concat('[', file_path, ':', start_line, '-', end_line, ']') AS citation FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT {q.m('lower(file_path)', dims.README_FILE)}, file_path, start_line, id, grade, CASE WHEN grade = 0 THEN -score ELSE 0 END, pos) AS rn FROM (
        SELECT *, CASE WHEN score > 0 THEN 0 WHEN {q.m('left(p, 140)', r'\bis (?:a|an|the|now)\b', 'i')} AND NOT {q.m('p', dims.META_NOISE, 'i')} THEN 1 WHEN NOT {q.m('p', dims.META_NOISE, 'i')} THEN 2 END AS grade FROM (
          SELECT *, {' + '.join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in _PTS)} AS score FROM (
            SELECT project_id, id, file_path, start_line, end_line, ps[i] AS p, i AS pos FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(code, chr(10) || '{{2,}}'), lambda p: {_CLEAN}),
              lambda p: length(p) >= 40 AND NOT {q.m('p', r'^donate\b', 'i')} AND NOT {q.m('p', dims.BOILERPLATE, 'i')}) AS ps FROM {source} WHERE {q.m('lower(file_path)', dims.OVERVIEW_DOC)}), range(1, len(ps) + 1) r(i)))) WHERE grade IS NOT NULL)
      WHERE rn = 1"""


@query("overview_statement", overview_sql("tree_units"))
def _(spark, sf):
    return followup.overview_statement(corpus.tree_units(spark, sf))


# --- sources of answers and sessions ---------------------------------------------------------------


@query(
    "resolve_citation_sources",
    f"""SELECT answer_id, file_path, name, concat(start_line, '-', end_line) AS lines, row_number() OVER (PARTITION BY answer_id ORDER BY {q.m('file_path', dims.DOC_FILE, 'i')}, file_path, start_line, end_line) AS ord FROM (
      SELECT answer_id, file_path, start_line, end_line, arg_min(name, (tier, pos, name)) AS name FROM (
        SELECT answer_id, file_path, name, start_line, end_line, 0 AS tier, 0 AS pos FROM v_ctx UNION ALL
        SELECT answer_id, arg_min(file_path, (loose, ord)), arg_min(name, (loose, ord)), s, e, 1, pos + 1 FROM (
          SELECT c.answer_id, c.pos, c.start_line AS s, c.end_line AS e, r.file_path, r.name, r.ord, CASE WHEN r.path = {norm_sql('r.file_path')} THEN 0 ELSE 1 END AS loose FROM v_judged c
          JOIN v_ranges r ON r.answer_id = c.answer_id AND r.path = c.path AND c.start_line >= r.start_line AND c.end_line <= r.end_line WHERE c.valid AND NOT c.line_only) GROUP BY answer_id, pos, s, e) GROUP BY ALL)""",
)
def _(spark, sf):
    return followup.citation_sources(context_units(spark, sf), judged(spark, sf))


views.register(
    "v_session_units",
    f"""SELECT session_id, project_id, pos, id, unit_id, file_path, name, start_line, end_line, CASE WHEN rs IS NULL OR ex = '' THEN array_to_string(list_slice(ls, 1, 40), chr(10)) ELSE ex END AS code FROM (
      SELECT *, {q.trim("array_to_string(list_slice(ls, skip + 1, greatest(skip + 1, re - from_line + 1)), chr(10))")} AS ex, row_number() OVER (PARTITION BY session_id, id ORDER BY pos) AS n FROM (
        SELECT session_id, project_id, pos, file_path, rs, re, uid AS unit_id, from_line, string_split(code, chr(10)) AS ls, greatest(0, rs - from_line) AS skip, CASE WHEN rs IS NOT NULL AND given <> '' THEN given ELSE uname END AS name,
          CASE WHEN rs IS NULL THEN concat('session-source:', uid) ELSE concat('session-source:', file_path, ':', lines) END AS id, coalesce(rs, from_line) AS start_line, coalesce(re, to_line) AS end_line,
          row_number() OVER (PARTITION BY session_id, pos ORDER BY loose, from_line, uid) AS rn FROM (
          SELECT r.*, u.id AS uid, u.name AS uname, u.code, u.start_line AS from_line, u.end_line AS to_line, CASE WHEN rs IS NULL THEN CASE WHEN u.kind = 'module' THEN 0 ELSE 1 END WHEN rs >= u.start_line AND re <= u.end_line THEN 0 ELSE 1 END AS loose
          FROM (SELECT session_id, project_id, pos, file_path, name AS given, lines, TRY_CAST(nullif(regexp_extract(lines, '^(\\d+)(?:-\\d+)?$', 1), '') AS INTEGER) AS rs,
              TRY_CAST(coalesce(nullif(regexp_extract(lines, '^\\d+-(\\d+)$', 1), ''), regexp_extract(lines, '^(\\d+)$', 1)) AS INTEGER) AS re FROM v_session_refs) r
          JOIN units u ON u.project_id = r.project_id AND u.file_path = r.file_path AND (rs IS NULL OR (rs >= u.start_line AND re <= u.end_line) OR (u.start_line <= re AND u.end_line >= rs)))) WHERE rn = 1) WHERE n = 1""",
)


@query("session_source_units", "SELECT session_id, pos, id, unit_id, file_path, name, start_line, end_line, md5(code) AS code FROM v_session_units")
def _(spark, sf):
    found = followup.session_source_units(followup.session_refs(corpus.sessions(spark, sf)), corpus.units(spark, sf))
    return found.select("session_id", "pos", "id", "unit_id", "file_path", "name", "start_line", "end_line", F.md5("code").alias("code"))


# --- follow-up retrieval -------------------------------------------------------------------------------

def _asked(spark, sf):
    """Every question as a follow-up in the latest completed session of its project."""
    f = questions.followup_intent(F.col("query"))
    rows = corpus.queries(spark, sf).withColumn("followup", f).withColumn(
        "query", questions.expand_followup(F.col("query"), F.col("followup"))
    )
    latest = history.latest_completed(corpus.sessions(spark, sf))
    files = latest.select("project_id", "session_id").join(history.session_source_files(latest), "session_id")
    none = F.array().cast("array<string>")
    return rows.join(files, "project_id", "left").withColumn("source_files", F.coalesce("source_files", none))


from srcloom.plans.history_queries import _DONE as DONE_SQL  # noqa: E402
from srcloom.plans.history_queries import _FILES as FILES_SQL  # noqa: E402
from srcloom.plans.text_queries import EXPAND_SQL, FOLLOWUP_SQL  # noqa: E402

views.register(
    "v_followups",
    f"""SELECT query_id, q.project_id, followup, query, s.session_id, coalesce(s.files, CAST([] AS VARCHAR[])) AS files FROM (SELECT query_id, project_id, followup, {EXPAND_SQL} AS query FROM (SELECT *, {FOLLOWUP_SQL} AS followup FROM queries)) q
      LEFT JOIN (SELECT project_id, arg_max(session_id, (updated_at, created_at, session_id)) AS session_id, arg_max({FILES_SQL}, (updated_at, created_at, session_id)) AS files
        FROM (SELECT *, session_id % 5 AS event_case FROM sessions) WHERE {DONE_SQL} GROUP BY project_id) s ON s.project_id = q.project_id""",
)
_PT = "lower(concat_ws(' ', file_path, name, code))"
views.register(
    "v_pinned",
    f"""SELECT query_id, project_id, unit_id, 'pinned' AS channel, 1001.0::DOUBLE - rank AS score, rank, is_vendored FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_pos, n) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, file_pos ORDER BY pin DESC, start_line, unit_id) AS n FROM (
          SELECT f.query_id, f.project_id, list_position(f.files, u.file_path) AS file_pos, u.id AS unit_id, u.start_line, u.is_vendored,
            CASE WHEN kind IN ('function', 'method') THEN 14 WHEN kind = 'class' THEN CASE WHEN nl > 250 THEN -8 ELSE 6 END ELSE CASE WHEN nl > 220 THEN -14 ELSE 4 END END
            + CASE WHEN nl <= 80 THEN 8 WHEN nl <= 180 THEN 3 ELSE -10 END + 4 * len(list_filter(regexp_split_to_array(lower(f.query), '[^a-z0-9_]+'), lambda t: length(t) > 3 AND contains({_PT}, t)))
            + CASE WHEN {q.m(_PT, followup.PIN_WORDS)} THEN 8 ELSE 0 END + CASE WHEN {q.m('lower(file_path)', followup.PIN_SKIP)} THEN -30 ELSE 0 END AS pin
          FROM v_followups f JOIN (SELECT *, end_line - start_line + 1 AS nl FROM units WHERE NOT is_vendored) u ON u.project_id = f.project_id AND list_contains(f.files, u.file_path))) WHERE n <= 3) WHERE rank <= 12""",
)


@query("pinned_source_units", "SELECT * FROM v_pinned")
def _(spark, sf):
    return followup.pinned_units(_asked(spark, sf), corpus.units(spark, sf))


def _hits(spark, sf, asked, units):
    """Channel hits of the expanded questions and the hits of the follow-ups, stored tables."""
    plain = asked.select("query_id", "project_id", "query")
    hits = shared(spark, sf, "followup-hits", lambda: retrieve.all_channels(plain, units, answer.CHANNEL_K))
    return shared(spark, sf, "followup-found", lambda: followup.followup_hits(asked, hits, units))


@query("followup_retrieval")
def _(spark, sf):
    asked = shared(spark, sf, "followups", lambda: answer.plans(_asked(spark, sf)))
    return _hits(spark, sf, asked, corpus.units(spark, sf)).withColumn("score", F.round("score", 6))


@query("pack_followup")
def _(spark, sf):
    asked = shared(spark, sf, "followups", lambda: answer.plans(_asked(spark, sf)))
    units = corpus.units(spark, sf)
    sessions = corpus.sessions(spark, sf).join(asked.select("session_id").distinct(), "session_id", "left_semi")
    # Excerpts are short, and three steps read them.
    excerpts = stage(followup.session_source_units(followup.session_refs(sessions), units), "excerpts")
    cited = excerpts.select("session_id", F.col("id").alias("unit_id"), F.col("pos").alias("rank"))
    sources = asked.select("query_id", "project_id", "session_id").join(cited, "session_id").drop("session_id")
    # An excerpt's name may differ from session to session; as a unit of its project it has one.
    first = Window.partitionBy("project_id", "id").orderBy("session_id", "pos")
    one = excerpts.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    found = _hits(spark, sf, asked, units).withColumnRenamed("ord", "rank")
    packed = followup.pack_followup(asked, sources, found, units.unionByName(one.select(units.columns)))
    return packed.select("query_id", "project_id", "unit_id", "file_path", "start_line", "end_line", "tokens", "exact", "slot")
