"""Registered queries for sessions, messages, reports and file slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import questions
from srcloom.operators import history
from srcloom.registry import query
from srcloom.sources import corpus

_DONE = "trim(brief) <> '' AND NOT generation_truncated"


@query(
    "latest_completed_session",
    f"""SELECT project_id, session_id, audience, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, created_at DESC, session_id DESC) AS rn
      FROM sessions WHERE {_DONE}) WHERE rn = 1""",
)
def _(spark, sf):
    return history.latest_completed(corpus.sessions(spark, sf)).select("project_id", "session_id", "audience", "updated_at")


@query(
    "briefing_rollup",
    f"""SELECT project_id, unit_count, latest_briefing_at, latest_briefing_at IS NOT NULL AS has_completed_briefing FROM (
      SELECT project_id, count(*) AS unit_count FROM units GROUP BY project_id) LEFT JOIN (
      SELECT project_id, max(updated_at) AS latest_briefing_at FROM sessions WHERE {_DONE} GROUP BY project_id) USING (project_id)""",
)
def _(spark, sf):
    projects = corpus.units(spark, sf).groupBy("project_id").agg(F.count("*").alias("unit_count"))
    return history.briefing_rollup(projects, corpus.sessions(spark, sf))


@query(
    "message_tail",
    """SELECT session_id, ord, role, content, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS rn FROM messages) WHERE rn <= 3""",
)
def _(spark, sf):
    return history.message_tail(corpus.messages(spark, sf), 3)


views.register(
    "v_pairs",
    """SELECT session_id, ord, content AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS answer FROM messages
      WINDOW w AS (PARTITION BY session_id ORDER BY ord)) WHERE role = 'user' AND next_role = 'assistant'""",
)


def _trim_sql(x: str, n: int) -> str:
    head = f"left({x}, {n})"

    def last(sign, size):
        rev = sign[::-1]
        return f"CASE WHEN position({q.s(rev)} IN reverse({head})) > 0 THEN length({head}) - position({q.s(rev)} IN reverse({head})) - {size} + 1 ELSE -1 END"

    stop = f"greatest({last(chr(10) * 2, 2)}, {last(chr(10) + '- ', 3)}, {last('. ', 2)})"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat({q.trim(f'CASE WHEN {stop} > {n * 0.5} THEN left({head}, {stop} + 1) ELSE {head} END')}, chr(10), '[Truncated]') END"


def _squeeze(x: str) -> str:
    return q.trim(q.rep(x, r"\s+", " "))


@query(
    "followup_history",
    f"""SELECT session_id, ord, question, answer, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) <= 2 THEN
        concat('User: ', {_trim_sql('sq', 180)}, chr(10), 'Assistant: ', {_trim_sql('sa', 240)}) END AS prompt_line FROM (
      SELECT *, {_squeeze('question')} AS sq, {_squeeze('answer')} AS sa FROM (
        SELECT session_id, ord, left({q.trim('question')}, 1200) AS question, left({q.trim('answer')}, 2400) AS answer FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS rn FROM v_pairs) WHERE rn <= 6)
      WHERE question <> '' AND answer <> '')""",
)
def _(spark, sf):
    return history.followup_history(corpus.messages(spark, sf))


_FILES = """CASE event_case WHEN 0 THEN ['src/index.ts', 'README.md'] WHEN 1 THEN ['src/index.ts'] WHEN 2 THEN ['README.md'] ELSE CAST([] AS VARCHAR[]) END"""


@query(
    "session_source_files",
    f"SELECT session_id, array_to_string({_FILES}, '|') AS source_files FROM (SELECT *, session_id % 5 AS event_case FROM sessions)",
)
def _(spark, sf):
    return history.session_source_files(corpus.sessions(spark, sf)).withColumn("source_files", F.array_join("source_files", "|"))


@query(
    "markdown_report",
    f"""SELECT session_id, md5(concat({q.trim('''concat_ws(chr(10), concat('# project-', project_id, ' - Codebase Briefing'), '', concat('Generated: ', strftime(created_at, '%Y-%m-%d %H:%M:%S')),
        concat('Project: project-', project_id), '', '## Briefing', '', body, '', '## Sources', '', CASE WHEN len(fs) = 0 THEN 'No sources were returned for this briefing.'
          ELSE array_to_string(list_transform(fs, lambda p, i: concat(i, '. ', p, ' (module ', regexp_extract(p, '[^/]*$'), ', lines 1-1)')), chr(10)) END,
        CASE WHEN turns IS NOT NULL THEN concat(chr(10), '## Follow-up Questions', chr(10), chr(10), turns) END)''')}, chr(10))) AS report FROM (
      SELECT s.*, {q.trim('brief')} AS body, {_FILES.replace('event_case', '(s.session_id % 5)')} AS fs, t.turns FROM sessions s LEFT JOIN (
        SELECT p.session_id, string_agg(concat('### ', n, '. ', replace(audience, '_', ' '), chr(10), chr(10), 'Question: ', {q.trim('question')}, chr(10), chr(10), {q.trim('answer')}, chr(10)), chr(10) ORDER BY ord) AS turns
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM v_pairs) p JOIN sessions USING (session_id) GROUP BY p.session_id) t USING (session_id))""",
)
def _(spark, sf):
    pairs = history.question_answer_pairs(corpus.messages(spark, sf))
    return history.markdown_report(corpus.sessions(spark, sf), pairs).withColumn("report", F.md5("report"))


@query(
    "read_line_range",
    """SELECT k.project_id, owner_id, k.ord, file_path, start_line, end_line, md5(coalesce(array_to_string(list_slice(regexp_split_to_array(content, '\\r?\\n'), start_line, end_line), chr(10)), '')) AS code
      FROM kg_sources k JOIN files USING (project_id, file_path) WHERE end_line >= start_line""",
)
def _(spark, sf):
    out = history.read_line_range(corpus.kg_sources(spark, sf), corpus.files(spark, sf))
    return out.select("project_id", "owner_id", "ord", "file_path", "start_line", "end_line", F.md5("code").alias("code"))


@query(
    "read_excerpt",
    f"""SELECT project_id, file_path, 1 AS start_line, least({dims.SURVEY_EXCERPT_LINES}, len(ls)) AS end_line, md5(array_to_string(list_slice(ls, 1, {dims.SURVEY_EXCERPT_LINES}), chr(10))) AS text,
      array_to_string(kinds || CASE WHEN bytes > {dims.SURVEY_FILE_BYTES} OR len(ls) > {dims.SURVEY_EXCERPT_LINES} THEN ['excerpt_truncated'] ELSE CAST([] AS VARCHAR[]) END, '|') AS signals
      FROM (SELECT *, regexp_split_to_array(content, '\\r?\\n') AS ls FROM v_signals)""",
)
def _(spark, sf):
    from srcloom.functions import signals

    tree = corpus.tree_files(spark, sf).withColumn(
        "signals", signals.source_signals(F.col("file_path"), F.col("content"))["kind"]
    )
    return history.read_excerpt(tree).withColumns({"text": F.md5("text"), "signals": F.array_join("signals", "|")})


@query(
    "point_lookups",
    """SELECT DISTINCT r.query_id AS request_id, r.project_id, r.by, r.key, u.id AS unit_id FROM (
      SELECT DISTINCT query_id, project_id, 'name' AS by, unnest(idents) AS key FROM v_features UNION ALL
      SELECT DISTINCT query_id, project_id, 'class', unnest(idents) FROM v_features UNION ALL
      SELECT DISTINCT query_id, project_id, 'file', unnest(paths) FROM v_features) r JOIN units u ON u.project_id = r.project_id
      AND ((r.by = 'name' AND u.name = r.key) OR (r.by = 'file' AND u.file_path = r.key) OR (r.by = 'class' AND u.kind = 'method' AND u.parent_name = r.key))""",
)
def _(spark, sf):
    qc = F.col("query")
    asked = corpus.queries(spark, sf)

    def wanted(by, col):
        return asked.select(
            F.col("query_id").alias("request_id"), "project_id", F.lit(by).alias("by"), F.explode(col).alias("key")
        ).distinct()

    requests = wanted("name", questions.identifiers(qc)).unionByName(wanted("class", questions.identifiers(qc)))
    requests = requests.unionByName(wanted("file", questions.paths_in(qc)))
    return history.lookup_units(requests, corpus.units(spark, sf).drop("code"))
