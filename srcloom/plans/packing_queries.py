"""Registered queries for truncation, expansion, packing and context layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import tokens
from srcloom.operators import fuse, graph, pack
from srcloom.plans import answer, graph_queries
from srcloom.plans.retrieval_queries import TEST_DEMOTED, _hits, _plans, judged_units, total_sql, workflow_sql
from srcloom.plans.text_queries import redact_sql
from srcloom.registry import query
from srcloom.sources import corpus
from srcloom.staging import shared

BUDGET = dims.MAX_CONTEXT_TOKENS


def tokens_sql(x: str) -> str:
    return f"CAST(ceil(length({x}) / 3) AS BIGINT)"


def truncate_sql(source: str, limit: str, needles: str, keep: str) -> str:
    """Rows of ``source`` (file_path, code, start_line, end_line) cut to ``limit`` tokens."""
    return f"""SELECT {keep}, CASE WHEN t_small THEN code ELSE concat(CASE WHEN t_from > 0 THEN '// ... truncated above ...' || chr(10) ELSE '' END, t_part,
        CASE WHEN t_from + t_lim * 3 < length(code) THEN chr(10) || '// ... truncated below ...' ELSE '' END) END AS cut_code,
      CAST(CASE WHEN t_small THEN start_line ELSE t_new_start END AS INTEGER) AS cut_start,
      CAST(CASE WHEN t_small THEN end_line ELSE least(end_line, t_new_start + len(string_split(t_part, chr(10))) - 1) END AS INTEGER) AS cut_end FROM (
      SELECT *, substr(code, t_from + 1, t_lim * 3) AS t_part, start_line + len(string_split(substr(code, 1, t_from), chr(10))) - 1 AS t_new_start FROM (
        SELECT *, CASE WHEN t_raw = 0 OR NOT contains(substr(code, 1, t_raw + 1), chr(10)) THEN 0
            ELSE t_raw + 1 - position(chr(10) IN reverse(substr(code, 1, t_raw + 1))) + 1 END AS t_from FROM (
          SELECT *, CASE WHEN t_best = 0 THEN 0 ELSE greatest(0, t_best - 1 - CAST(floor(t_lim * 3 / 4) AS BIGINT)) END AS t_raw FROM (
            SELECT *, CASE WHEN t_hit > 0 THEN t_hit WHEN {q.m('file_path', r'\.(md|mdx)$', 'i')} AND {q.m('code', r'^#\s+\S.*$', 'm')}
                THEN length(regexp_extract(code, '(?s)^((?:.*?\\n)??)#[\\t ]+[^\\s]', 1)) + 1 ELSE 0 END AS t_best FROM (
              SELECT *, {limit} AS t_lim, {tokens_sql('code')} <= {limit} AS t_small,
                coalesce(list_filter(list_transform({needles}, lambda n: position(n IN lower(code))), lambda p: p > 0)[1], 0) AS t_hit FROM ({source}))))))"""


# Limits small enough for the window to move on the given texts.
SMALL_LIMIT = 60


@query(
    "truncate_unit",
    f"""SELECT query_id, id, md5(cut_code) AS code, cut_start AS start_line, cut_end AS end_line FROM (
      {truncate_sql("SELECT v.query_id, v.short_needles || list_transform(v.terms, lambda t: t.value) AS ns, u.* FROM v_fused f JOIN v_features v USING (query_id) JOIN units u ON u.project_id = f.project_id AND u.id = f.unit_id",
                    str(SMALL_LIMIT), "ns", "query_id, id")})""",
)
def _(spark, sf):
    planned = _plans(spark, sf)
    fused = fuse.retrieve_by_plan(planned, _hits(spark, sf)).select("query_id", "project_id", F.col("unit_id").alias("id"))
    wanted = planned.select("query_id", F.concat("needles", "terms").alias("ns"))
    rows = fused.join(wanted, "query_id").join(corpus.units(spark, sf), ["project_id", "id"])
    return tokens.with_cut(rows, F.lit(SMALL_LIMIT), F.col("ns")).select(
        "query_id", "id", F.md5("cut_code").alias("code"), F.col("cut_start").alias("start_line"), F.col("cut_end").alias("end_line")
    )


_TRIM_MAX = 900


@query(
    "trim_to_budget",
    f"""SELECT project_id, id, cut_start AS start_line, cut_end AS end_line, running FROM (SELECT *, sum({tokens_sql('cut_code')}) OVER (PARTITION BY project_id
      ORDER BY file_path, id) AS running FROM ({truncate_sql("SELECT * FROM units", str(int(_TRIM_MAX * 0.4)), "CAST([] AS VARCHAR[])", "project_id, file_path, id")})) WHERE running <= {_TRIM_MAX}""",
)
def _(spark, sf):
    u = corpus.units(spark, sf).withColumn("ord", F.struct("file_path", "id"))
    return pack.trim_to_budget(u, "project_id", "ord", _TRIM_MAX).select("project_id", "id", "start_line", "end_line", "running")


# --- graph and class expansion -----------------------------------------------------------------------


def _walk(near, far):
    return f"""SELECT query_id, project_id, node, min(depth) AS depth FROM (
      SELECT query_id, project_id, file_path AS node, 0 AS depth FROM v_seeds
      UNION ALL SELECT s.query_id, s.project_id, e.{far}, 1 FROM v_seeds s JOIN v_edges e ON e.project_id = s.project_id AND e.{near} = s.file_path
      UNION ALL SELECT s.query_id, s.project_id, e2.{far}, 2 FROM v_seeds s JOIN v_edges e ON e.project_id = s.project_id AND e.{near} = s.file_path
        JOIN v_edges e2 ON e2.project_id = e.project_id AND e2.{near} = e.{far}) GROUP BY ALL"""


views.register("v_seeds", "SELECT DISTINCT query_id, project_id, file_path FROM v_reranked WHERE query_id IN (SELECT query_id FROM v_plans WHERE use_graph)")
views.register("v_walk_up", _walk("source_file", "target_file"))
views.register("v_walk_down", _walk("target_file", "source_file"))
views.register(
    "v_nodes",
    """SELECT query_id, project_id, node, min(depth) AS depth FROM (SELECT *, 'upstream' AS d FROM v_walk_up UNION ALL SELECT *, 'downstream' FROM v_walk_down)
      JOIN (SELECT query_id, traversal FROM v_features) USING (query_id) WHERE traversal = 'bidirectional' OR traversal = d GROUP BY ALL""",
)
views.register(
    "v_graphed",
    """SELECT query_id, project_id, unit_id, bonus, row_number() OVER (PARTITION BY query_id ORDER BY tier, bonus DESC, path, pos, uid) AS ord FROM (
      SELECT query_id, project_id, unit_id, 0 AS tier, 1.0::DOUBLE AS bonus, '' AS path, rank AS pos, '' AS uid FROM v_reranked WHERE query_id IN (SELECT query_id FROM v_plans WHERE use_graph)
      UNION ALL SELECT n.query_id, n.project_id, u.id, 1, CASE WHEN depth = 1 THEN 0.3 ELSE 0.1 END, node, u.start_line, u.id FROM v_nodes n
        JOIN units u ON u.project_id = n.project_id AND u.file_path = n.node WHERE depth > 0
          AND NOT EXISTS (SELECT 1 FROM v_reranked r WHERE r.query_id = n.query_id AND r.unit_id = u.id))""",
)


def import_edges(spark, sf):
    """The import graph is a stored table; several traversals read it."""
    return shared(spark, sf, "edges", lambda: graph_queries.edges(spark, sf))


def _stage(spark, sf):
    planned = _plans(spark, sf)
    units = judged_units(spark, sf)
    hits = shared(spark, sf, "ranked", lambda: answer.reranked(planned, corpus.queries(spark, sf), units))
    return planned, units, hits


@query("graph_expand", "SELECT * FROM v_graphed")
def _(spark, sf):
    planned, units, hits = _stage(spark, sf)
    hits = hits.join(planned.filter("use_graph").select("query_id"), "query_id", "left_semi")
    nodes = answer.reached_files(planned, hits, import_edges(spark, sf))
    return graph.expand_by_graph(hits, nodes, units.select("project_id", "id", "file_path", "start_line"))


views.register(
    "v_related",
    """SELECT query_id, project_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, line, unit_id) AS pos FROM (
      SELECT query_id, project_id, other AS unit_id, min((rank, line))[1] AS rank, min((rank, line))[2] AS line FROM (
        SELECT r.query_id, r.project_id, (SELECT arg_min(c.id, (c.start_line, c.id)) FROM units c WHERE c.project_id = u.project_id AND c.file_path = u.file_path AND c.kind = 'class' AND c.name = u.parent_name) AS other, r.rank,
          (SELECT min(c.start_line) FROM units c WHERE c.project_id = u.project_id AND c.file_path = u.file_path AND c.kind = 'class' AND c.name = u.parent_name) AS line
        FROM v_reranked r JOIN units u ON u.id = r.unit_id WHERE u.kind = 'method'
        UNION ALL SELECT r.query_id, r.project_id, m.id, r.rank, m.start_line FROM v_reranked r JOIN units u ON u.id = r.unit_id
          JOIN units m ON m.project_id = u.project_id AND m.file_path = u.file_path AND m.kind = 'method' AND m.parent_name = u.name WHERE u.kind = 'class')
      WHERE other IS NOT NULL AND (query_id, other) NOT IN (SELECT (query_id, unit_id) FROM v_reranked) GROUP BY ALL)""",
)
views.register(
    "v_called",
    """SELECT * FROM (SELECT query_id, project_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS pos FROM (
      SELECT query_id, project_id, unit_id, min((rank, call_pos)) AS first_at FROM (
        SELECT r.query_id, r.project_id, r.rank, i AS call_pos, n.id AS unit_id FROM v_reranked r JOIN units u ON u.id = r.unit_id, range(1, len(u.called_functions) + 1) c(i)
          JOIN (SELECT project_id, name, arg_min(id, (file_path, start_line, id)) AS id FROM units GROUP BY ALL) n ON n.project_id = r.project_id AND n.name = u.called_functions[i] WHERE r.rank <= 3)
      WHERE (query_id, unit_id) NOT IN (SELECT (query_id, unit_id) FROM v_reranked UNION ALL SELECT (query_id, unit_id) FROM v_related) GROUP BY ALL)) WHERE pos <= 5""",
)


@query("expand_class_method", "SELECT query_id, project_id, unit_id, pos FROM v_related")
def _(spark, sf):
    _, units, hits = _stage(spark, sf)
    return pack.class_and_method_neighbours(hits, units.drop("code"))


@query("expand_calls", "SELECT query_id, project_id, unit_id, pos FROM v_called")
def _(spark, sf):
    _, units, hits = _stage(spark, sf)
    heads = units.drop("code")
    related = pack.class_and_method_neighbours(hits, heads)
    included = hits.select("query_id", "unit_id").unionByName(related.select("query_id", "unit_id"))
    return pack.call_neighbours(hits, heads, included)


views.register(
    "v_expanded",
    f"""SELECT query_id, project_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, sort_path, pos) AS ord FROM (
      SELECT *, sum(CASE WHEN kept THEN tokens END) OVER (PARTITION BY query_id) AS used FROM (
        SELECT *, tier = 0 AND (running <= {BUDGET} OR nth = 1) AS kept FROM (
          SELECT *, sum(tokens) OVER w AS running, count(*) OVER w AS nth FROM (
            SELECT query_id, project_id, unit_id, tier, pos, CASE WHEN tier = 0 THEN '' ELSE file_path END AS sort_path, {tokens_sql('cut_code')} AS tokens FROM (
              {truncate_sql('''SELECT x.query_id, x.unit_id, x.tier, x.pos, u.* FROM (SELECT query_id, unit_id, 0 AS tier, rank AS pos FROM v_reranked
                  UNION ALL SELECT query_id, unit_id, 1, pos FROM v_related UNION ALL SELECT query_id, unit_id, 1, pos + 1000000 FROM v_called) x JOIN units u ON u.id = x.unit_id''',
                str(int(BUDGET * 0.4)), "CAST([] AS VARCHAR[])", "query_id, project_id, unit_id, tier, pos, file_path")}))
          WINDOW w AS (PARTITION BY query_id, tier ORDER BY sort_path, pos))))
      WHERE kept OR (tier = 1 AND used + running <= {BUDGET})""",
)


@query("expand_context_trim", "SELECT query_id, project_id, unit_id, ord FROM v_expanded")
def _(spark, sf):
    _, units, hits = _stage(spark, sf)
    return pack.expand_context(hits, units)


# --- packing --------------------------------------------------------------------------------------------

_EVID = "(len(list_filter(list_transform(paths, lambda p: lower(p)), lambda x: ends_with(lp, x))) > 0 OR len(list_filter(short_needles, lambda x: contains(lower({0}), x) OR contains(lp, x))) > 0)"
_META = """coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN ln = t.value THEN 10 WHEN contains(ln, t.value) THEN 4 ELSE 0 END
  + CASE WHEN contains(lp, t.value) THEN 3 ELSE 0 END + CASE WHEN list_contains(le, t.value) THEN 5 ELSE 0 END)), 0)"""
_PLANB = " + ".join(
    f"CASE WHEN list_contains({col}, {q.s(val)}) AND {q.holds(cond, {'path': 'file_path', 'path_lower': 'lp'})} THEN {p} ELSE 0 END"
    for p, col, val, cond in dims.PLAN_BONUS
)
views.register(
    "v_candidates",
    """SELECT query_id, project_id, unit_id, ord FROM v_graphed UNION ALL
      SELECT query_id, project_id, unit_id, ord FROM v_expanded WHERE query_id NOT IN (SELECT query_id FROM v_plans WHERE use_graph)""",
)
views.register(
    "v_pack_scores",
    f"""SELECT query_id, project_id, unit_id, ord, file_path, score, cut_code, cut_start AS start_line, cut_end AS end_line, {tokens_sql('cut_code')} AS tokens,
      {_EVID.format('cut_code')} AS exact, hit_rank, max_tokens, max_per_file FROM ({truncate_sql(
        f'''SELECT *, CASE WHEN best > 0 THEN coalesce(hit, 0) / best * 20 ELSE 0 END + {_META} + CASE WHEN {_EVID.format('code')} THEN 20 ELSE 0 END
          + CASE WHEN {q.m('query', dims.SUPPORT_QUERY, 'i')} THEN support ELSE 0 END + {total_sql(workflow_sql(1))} + ({_PLANB})
          + CASE WHEN {TEST_DEMOTED} THEN -120 ELSE 0 END + CASE kind WHEN 'class' THEN 3.0::DOUBLE WHEN 'function' THEN 2.5 WHEN 'method' THEN 2.0 ELSE 1.5 END
          + CASE WHEN len(exported_names) > 0 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN is_vendored THEN -10 ELSE 0 END - (ord - 1) * 0.001::DOUBLE AS score FROM (
          SELECT c.ord, u.*, u.id AS unit_id, v.query_id, v.query, lower(v.query) AS lq, v.terms, v.short_needles, v.paths, r.score AS hit, r.rank AS hit_rank,
            lower(concat_ws(' ', u.lp, u.name, u.code)) AS stage_text, p.required_evidence, p.preferred_sources,
            greatest(500, CAST(floor({BUDGET} * p.ratio) AS INTEGER)) AS max_tokens, CASE WHEN p.mode = 'summary_graph' THEN 2 ELSE 3 END AS max_per_file,
            (SELECT greatest(max(b.score), 0) FROM v_reranked b WHERE b.query_id = c.query_id) AS best
          FROM v_candidates c JOIN v_features v ON v.query_id = c.query_id JOIN v_plans p ON p.query_id = c.query_id
          JOIN v_unit_facts u ON u.project_id = c.project_id AND u.id = c.unit_id LEFT JOIN v_reranked r ON r.query_id = c.query_id AND r.unit_id = c.unit_id)''',
        "CAST(floor(max_tokens * 0.4::DOUBLE) AS INTEGER)", "short_needles",
        "query_id, project_id, unit_id, ord, file_path, score, hit_rank, max_tokens, max_per_file, paths, short_needles, lp")})""",
)


@query(
    "pack_score",
    "SELECT query_id, unit_id, ord, round(score, 6) AS pack_score, tokens, start_line, end_line, exact, hit_rank FROM v_pack_scores",
)
def _(spark, sf):
    planned, units, hits = _stage(spark, sf)
    chosen = answer.candidates(planned, hits, units, import_edges(spark, sf))
    scored = pack.pack_scores(planned, chosen, hits, units)
    return scored.select(
        "query_id", "unit_id", "ord", F.round("pack_score", 6).alias("pack_score"), "tokens", "start_line", "end_line", "exact", "hit_rank"
    )


def greedy_sql(source: str, group: str, order: str) -> str:
    """Recursive walk: keep a row when its file has room and its tokens fit."""
    return f"""WITH RECURSIVE seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS step FROM {source}),
      walk AS (SELECT {group} AS g, step, tokens <= max_tokens AS kept, CASE WHEN tokens <= max_tokens THEN tokens ELSE 0 END AS total,
          CASE WHEN tokens <= max_tokens THEN [file_path] ELSE CAST([] AS VARCHAR[]) END AS files FROM seq WHERE step = 1
        UNION ALL
        SELECT g, step, kept, total + CASE WHEN kept THEN tokens ELSE 0 END, CASE WHEN kept THEN list_append(files, file_path) ELSE files END FROM (
          SELECT w.g, s.step, w.total, w.files, s.tokens, s.file_path, w.total + s.tokens <= s.max_tokens
            AND len(list_filter(w.files, lambda f: f = s.file_path)) < CASE WHEN s.exact THEN greatest(s.max_per_file, 5) ELSE s.max_per_file END AS kept
          FROM walk w JOIN seq s ON s.{group} = w.g AND s.step = w.step + 1))
      SELECT s.* FROM seq s JOIN walk w ON w.g = s.{group} AND w.step = s.step WHERE w.kept"""


views.register(
    "v_packed",
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score / 5) DESC, coalesce(hit_rank, 2147483647), file_path, start_line, ord) AS slot
      FROM ({greedy_sql('v_pack_scores', 'query_id', 'score DESC, ord')})""",
)


def _packed(spark, sf):
    planned, units, hits = _stage(spark, sf)

    def build():
        chosen = answer.candidates(planned, hits, units, import_edges(spark, sf))
        return pack.pack(pack.pack_scores(planned, chosen, hits, units))

    return planned, shared(spark, sf, "packed", build)


@query(
    "pack_context",
    "SELECT query_id, project_id, unit_id, file_path, start_line, end_line, tokens, exact, round(score, 6) AS pack_score, slot FROM v_packed",
)
def _(spark, sf):
    _, packed = _packed(spark, sf)
    return packed.select(
        "query_id", "project_id", "unit_id", "file_path", "start_line", "end_line", "tokens", "exact",
        F.round("pack_score", 6).alias("pack_score"), "slot",
    )


def _context(spark, sf):
    planned, packed = _packed(spark, sf)
    return pack.context_text(packed, planned, judged_units(spark, sf))


def _context_lines(spark, sf):
    return pack.context_lines(_packed(spark, sf)[1], judged_units(spark, sf))


_TAG = "concat(file_path, ':', start_line, '-', end_line)"
views.register(
    "v_context",
    """SELECT p.query_id, p.project_id, p.unit_id, p.slot, p.file_path, u.name, u.kind, u.language, u.docstring, p.cut_code AS code, p.start_line, p.end_line
      FROM v_packed p JOIN units u ON u.project_id = p.project_id AND u.id = p.unit_id""",
)


@query(
    "format_context",
    f"""SELECT query_id, md5(concat('## Allowed Citations', chr(10), string_agg(concat('- [', {_TAG}, '] ', kind, ' ', name), chr(10) ORDER BY slot), chr(10), chr(10),
      string_agg(concat('### ', {_TAG}, ' - ', kind, ' ', name, chr(10), '```', language, chr(10), replace({redact_sql('file_path', 'code')}, '```', '``\\`'), chr(10), '```'), chr(10) || chr(10) ORDER BY slot))) AS context
      FROM v_context GROUP BY query_id""",
)
def _(spark, sf):
    return pack.format_context(_context(spark, sf)).withColumn("context", F.md5("context"))


@query(
    "source_list",
    f"""SELECT query_id, file_path, name, kind, concat(start_line, '-', end_line) AS lines,
      row_number() OVER (PARTITION BY query_id ORDER BY {q.m('file_path', dims.DOC_FILE, 'i')}, file_path, start_line, slot) AS ord FROM v_context""",
)
def _(spark, sf):
    return pack.source_list(_context_lines(spark, sf))


@query(
    "evidence_fallback_answer",
    f"""SELECT query_id, coalesce(answer, 'The provided context does not include enough source evidence to answer this question.') AS answer FROM queries LEFT JOIN (
      SELECT query_id, string_agg(concat('- ', coalesce(nullif({q.trim('docstring')}, ''), concat(kind, ' ', name, ' is available as source evidence for this follow-up question.')), ' [', {_TAG}, ']'), chr(10) ORDER BY slot) AS answer
      FROM v_context WHERE slot <= 4 GROUP BY query_id) USING (query_id)""",
)
def _(spark, sf):
    return pack.fallback_answer(corpus.queries(spark, sf), _context_lines(spark, sf))
