"""DuckDB text of the input views in :mod:`srcloom.sources.corpus`."""

from __future__ import annotations

import re

from srcloom.checks.sqlkit import arr, s
from srcloom.sources import corpus as c


def _case(col, mapping, default):
    whens = " ".join(f"WHEN {s(k) if isinstance(k, str) else k} THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


_HEAD = _case(
    "file_path",
    {k: s(v) for k, v in c.SPECIAL_CONTENT.items()},
    _case("regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)", {k: s(v) for k, v in c.CODE_HEADERS.items()}, "''"),
)
_N, _T, _A = len(c.SMALL_LAYOUT), len(c.TREE_LAYOUT), len(c.ANSWER_TAILS)
_NOARR = "CAST([] AS VARCHAR[])"

VIEWS = {
    "files": f"""SELECT CAST(floor(doc_id / {_N}) AS BIGINT) AS project_id, doc_id,
      {arr(c.SMALL_LAYOUT)}[doc_id % {_N} + 1] AS file_path, doc_id % {_N} = 10 AS is_vendored,
      octet_length(encode(text)) AS bytes, text AS content FROM documents""",
    "tree_files": f"""SELECT project_id, doc_id, file_path, content, octet_length(encode(content)) AS bytes FROM (
      SELECT project_id, doc_id, file_path, concat({_HEAD}, text) AS content FROM (
        SELECT CAST(floor(doc_id / {_T}) AS BIGINT) AS project_id, doc_id,
          {arr(c.TREE_LAYOUT)}[doc_id % {_T} + 1] AS file_path, text FROM documents))""",
    "lines": """SELECT project_id, doc_id, file_path, is_vendored, CAST(i AS INTEGER) AS line_no, ls[i] AS line
      FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files), range(1, len(ls) + 1) r(i)""",
    "units": f"""SELECT concat('u', doc_id, '-', unit_no) AS id, project_id, file_path,
      ['module', 'function', 'class', 'method'][unit_no % 4 + 1] AS kind,
      concat({_case("slot", {k: s(v) for k, v in c._NAMES.items()}, "'package'")}, unit_no) AS name, code,
      start_line, end_line,
      CASE WHEN unit_no % 4 = 3 THEN concat(CASE slot WHEN 5 THEN 'runPipeline' ELSE 'other' END, unit_no - 1) END AS parent_name,
      is_vendored, {_case("slot", {k: arr(v) for k, v in c._IMPORTS.items()}, _NOARR)} AS imports,
      CASE WHEN unit_no % 4 = 1 AND doc_id % 3 = 0 THEN concat('Loads and saves records for file ', doc_id) END AS docstring,
      CASE WHEN slot IN (2, 3, 4, 5, 8) THEN [concat('exported', unit_no), 'LLAMA_SERVER_URL'] ELSE {_NOARR} END AS exported_names,
      {_case("slot", {k: arr(v) for k, v in c._CALLS.items()}, _NOARR)} AS called_functions,
      {_case("slot", {k: s(v) for k, v in c._LANGS.items()}, "'typescript'")} AS language
      FROM (SELECT project_id, doc_id, file_path, is_vendored, CAST(floor((line_no - 1) / 8) AS INTEGER) AS unit_no,
        doc_id % {_N} AS slot, min(line_no) AS start_line, max(line_no) AS end_line,
        string_agg(line, chr(10) ORDER BY line_no) AS code
        FROM lines GROUP BY ALL)""",
    "queries": f"""SELECT concat('g', project_id, '-', k) AS query_id, project_id, {arr(c.GOLDEN_QUESTIONS)}[k] AS query
      FROM (SELECT DISTINCT CAST(floor(doc_id / {_N}) AS BIGINT) AS project_id FROM documents),
        range(1, {len(c.GOLDEN_QUESTIONS) + 1}) g(k)
      UNION ALL SELECT concat('c', conv_id, '-', turn), (conv_id // 12)::BIGINT, text FROM conversations WHERE role = 'user'""",
    "answers": f"""SELECT conv_id * 100 + turn AS answer_id, (conv_id // 12)::BIGINT AS project_id,
      concat('### Product In One Paragraph', chr(10), 'The stage loads settings and opens the store before it writes any record',
        tail, chr(10), chr(10), '### Top User Workflows', chr(10),
        '3. **Flow**: The team shares private access tokens and collects analytics data', tail, chr(10), chr(10),
        '#### Empty', chr(10), chr(10), '### Risks Or Open Questions', chr(10), '- ', text) AS answer
      FROM (SELECT *, {arr(c.ANSWER_TAILS)}[(conv_id + turn) % {_A} + 1] AS tail FROM conversations WHERE role = 'assistant')""",
    "sessions": """SELECT event_id AS session_id, (user_id // 12)::BIGINT AS project_id, event_type AS audience,
      CASE WHEN event_id % 7 = 0 THEN '   ' ELSE props END AS brief, event_type = 'error' AS generation_truncated,
      ts AS created_at, ts AS updated_at,
      CASE event_id % 5 WHEN 0 THEN '["src/index.ts", "README.md"]' WHEN 1 THEN '["src/index.ts", 7]'
        WHEN 2 THEN '[null, "README.md"]' WHEN 3 THEN '{bad' ELSE '[]' END AS source_files_json FROM events""",
    "v_session_refs": "SELECT event_id AS session_id, (user_id // 12)::BIGINT AS project_id, i - 1 AS pos, p.file_path, p.name, replace(replace(replace(p.lines, '{a}', (event_id % 11 + 1)::VARCHAR), '{b}', (event_id % 11 + 1 + event_id % 5)::VARCHAR), '{c}', (event_id % 90 + 1)::VARCHAR) AS lines FROM events, (VALUES "
    + ", ".join(f"({i}, {s(path)}, {s(name)}, {s(lines)})" for i, (path, name, _, lines) in enumerate(c.SESSION_SOURCES, 1))
    + ") p(i, file_path, name, lines) WHERE event_id % 9 <> 8",
    "messages": "SELECT conv_id AS session_id, turn AS ord, role, text AS content FROM conversations",
    "kg_nodes": f"""SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS project_id, concat('n', p_partkey) AS node_id,
      {arr(c.NODE_KINDS)}[p_partkey % 8 + 1] AS type, p_name AS label, concat('Summary of ', p_name, ' ', p_type) AS summary,
      CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence FROM part""",
    "kg_edges": """SELECT CAST(floor(c_custkey / 25) AS BIGINT) AS project_id, concat('e', c_custkey) AS edge_id,
      CASE c_custkey % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'calls' ELSE 'depends_on' END AS type,
      concat('n', c_custkey) AS from_id, concat('n', c_custkey + 1 + c_nationkey % 5) AS to_id,
      CASE c_custkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM customer""",
    "kg_sources": """SELECT CAST(floor(o_custkey / 25) AS BIGINT) AS project_id,
      concat(CASE o_orderkey % 2 WHEN 0 THEN 'n' ELSE 'e' END, o_custkey) AS owner_id, o_orderkey AS ord,
      CASE o_orderkey % 3 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'src/db/store.ts' ELSE 'README.md' END AS file_path,
      CAST(o_orderkey % 6 + 1 AS INTEGER) AS start_line,
      CAST(o_orderkey % 6 + 1 + o_orderkey % 5 - CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) AS end_line
      FROM orders""",
    "tree_units": """SELECT concat('t', doc_id, '-', no) AS id, project_id, file_path, CASE WHEN no = 0 THEN 'module' WHEN doc_id % 2 = 0 THEN 'function' ELSE 'class' END AS kind,
      concat(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', ''), doc_id % 5) AS name, array_to_string(list_slice(ls, a, b), chr(10)) AS code, a AS start_line, b AS end_line,
      starts_with(file_path, 'vendor/') AS is_vendored, CASE WHEN doc_id % 3 = 0 THEN ['import a from "./a"', 'import b'] ELSE CAST([] AS VARCHAR[]) END AS imports,
      CASE WHEN doc_id % 4 = 1 THEN ['exportOne', 'shareLink'] ELSE CAST([] AS VARCHAR[]) END AS exported_names,
      CASE WHEN doc_id % 5 = 2 THEN ['save', 'db.load', 'load'] ELSE CAST([] AS VARCHAR[]) END AS called_functions,
      CASE WHEN doc_id % 6 = 3 THEN 'Keeps the record' END AS docstring FROM (
      SELECT *, unnest([0, 1]) AS no, unnest([1, 11]) AS a, unnest([least(10, len(ls)), len(ls)]) AS b FROM (SELECT *, string_split(content, chr(10)) AS ls FROM tree_files)) WHERE b >= a""",
    "edge_list": """SELECT DISTINCT l_suppkey AS source_id, l_partkey + 1 AS target_id FROM lineitem
      WHERE l_suppkey <> l_partkey + 1""",
}


def register(name: str, body: str) -> None:
    """Add a derived step that later check queries can refer to by name."""
    VIEWS[name] = body


def sql(body: str) -> str:
    """Prefix ``body`` with the views it refers to, directly or through others."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in open_names and re.search(rf"(?<![\w'(|]){name}\b(?![?|'])", text):
                open_names.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n.startswith('v_') else ''}({VIEWS[n]})" for n in needed) + "\n" + body
