"""Registered queries for the import graph and the project profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.operators import graph, profile
from srcloom.registry import query
from srcloom.sources import corpus

_SPECS = " || ".join(q.exall("import_statement", p, 1, f) for p, f in dims.IMPORT_SPECIFIERS)
views.register(
    "v_specifiers",
    f"""SELECT DISTINCT project_id, source_file, import_statement, specifier FROM (
      SELECT project_id, source_file, import_statement, unnest({_SPECS}) AS specifier FROM (
        SELECT project_id, file_path AS source_file, unnest(imports) AS import_statement FROM units))
      WHERE regexp_matches(specifier, '^([.]|@/|src/)')""",
)


def specifiers(spark, sf):
    return graph.import_specifiers(corpus.units(spark, sf))


@query("import_specifiers", "SELECT * FROM v_specifiers")
def _(spark, sf):
    return specifiers(spark, sf).drop("seen")


# The small layout nests at most three folders, so this check resolves '..' by three rewrites.
_JOINED = f"CASE WHEN starts_with(specifier, '.') THEN concat({q.dirname('source_file')}, '/', specifier) ELSE regexp_replace(specifier, '^@/', 'src/') END"
_UP = "regexp_replace(@, '(^|/)[^/.]+/\\.\\./', '\\1')"
_SUFFIXES = [""] + dims.RESOLVE_SUFFIXES
views.register(
    "v_edges",
    f"""SELECT project_id, source_file, target_file, arg_min(import_statement, (first_line, first_pos, spec_pos)) AS import_statement, 'imports' AS edge_type FROM (
      SELECT s.project_id, s.source_file, s.import_statement, s.specifier, arg_min(f.file_path, c.pos) AS target_file,
        any_value(s.first_line) AS first_line, any_value(s.first_pos) AS first_pos, any_value(s.spec_pos) AS spec_pos
      FROM (SELECT v.*, m.first_line, m.first_pos, list_position({_SPECS.replace('import_statement', 'v.import_statement')}, specifier) AS spec_pos,
          {_UP.replace('@', _UP.replace('@', f"regexp_replace(regexp_replace(regexp_replace({_JOINED}, '/\\./', '/', 'g'), '/\\./', '/', 'g'), '^\\./', '')"))} AS resolved
        FROM v_specifiers v JOIN (SELECT project_id, file_path, imp, min(start_line) AS first_line, min(pos) AS first_pos
          FROM (SELECT project_id, file_path, start_line, imports[i] AS imp, i AS pos FROM units, range(1, len(imports) + 1) r(i)) GROUP BY ALL) m ON m.project_id = v.project_id AND m.file_path = v.source_file AND m.imp = v.import_statement) s,
        LATERAL (SELECT s.resolved AS path, -1 AS pos UNION ALL SELECT concat(regexp_replace(s.resolved, '\\.[^./]*$', ''), suffix), i FROM
          (SELECT unnest({q.arr(_SUFFIXES)}) AS suffix, unnest(range({len(_SUFFIXES)})) AS i)) c
      JOIN (SELECT DISTINCT project_id, file_path FROM units) f ON f.project_id = s.project_id AND f.file_path = c.path
      GROUP BY ALL) GROUP BY project_id, source_file, target_file""",
)


def edges(spark, sf):
    return graph.resolve_dependencies(specifiers(spark, sf), corpus.units(spark, sf))


@query("resolve_dependencies", "SELECT * FROM v_edges")
def _(spark, sf):
    return edges(spark, sf)


# --- traversal ---------------------------------------------------------------------------------

views.register("v_bulk_seeds", "SELECT s_suppkey AS query_id, s_suppkey AS node FROM supplier")


def _walk_sql(near: str, far: str, name: str) -> str:
    return f"""SELECT query_id, node, min(depth) AS depth FROM (
      SELECT query_id, node, 0 AS depth FROM v_bulk_seeds
      UNION ALL SELECT s.query_id, e.{far}, 1 FROM v_bulk_seeds s JOIN edge_list e ON e.{near} = s.node
      UNION ALL SELECT DISTINCT a.query_id, e.{far}, 2 FROM (SELECT DISTINCT s.query_id, e.{far} AS node FROM v_bulk_seeds s JOIN edge_list e ON e.{near} = s.node) a
        JOIN edge_list e ON e.{near} = a.node) GROUP BY query_id, node"""


views.register("v_up", _walk_sql("source_id", "target_id", "upstream"))
views.register("v_down", _walk_sql("target_id", "source_id", "downstream"))


def _bulk(spark, sf):
    seeds = corpus.table(spark, sf, "supplier").selectExpr(
        "s_suppkey as query_id", "s_suppkey as node"
    )
    return seeds, corpus.edge_list(spark, sf).selectExpr("source_id as source", "target_id as target")


def _traverse_query(name, mode, sql):
    @query(name, sql)
    def _(spark, sf):
        seeds, links = _bulk(spark, sf)
        return graph.traverse(seeds, links, 2, mode)


_dir_sql = "SELECT query_id, node, depth, CASE WHEN depth = 0 THEN 'seed' ELSE '{0}' END AS direction FROM {1}"
_traverse_query("traverse_upstream", "upstream", _dir_sql.format("upstream", "v_up"))
_traverse_query("traverse_downstream", "downstream", _dir_sql.format("downstream", "v_down"))
_traverse_query(
    "traverse_bidirectional",
    "bidirectional",
    """SELECT query_id, node, CASE WHEN d.depth IS NULL OR u.depth <= d.depth THEN u.depth ELSE d.depth END AS depth,
      CASE WHEN least(u.depth, d.depth) = 0 THEN 'seed' WHEN d.depth IS NULL OR u.depth <= d.depth THEN 'upstream' ELSE 'downstream' END AS direction
      FROM v_up u FULL JOIN v_down d USING (query_id, node)""",
)


@query("edge_type_counts", "SELECT project_id, edge_type, count(*) AS n FROM v_edges GROUP BY ALL")
def _(spark, sf):
    return graph.edge_type_counts(edges(spark, sf))


_FROM, _TO = q.dirname("source_file"), q.dirname("target_file")
views.register(
    "v_dir_edges", f"SELECT DISTINCT project_id, {_FROM} AS from_dir, {_TO} AS to_dir FROM v_edges WHERE {_FROM} <> {_TO}"
)
views.register(
    "v_entries",
    f"""SELECT DISTINCT project_id, file_path FROM units u WHERE list_contains({q.arr(dims.ENTRY_BASENAMES)}, {q.basename('file_path')})
      OR (EXISTS (SELECT 1 FROM v_edges e WHERE e.project_id = u.project_id AND e.source_file = u.file_path)
        AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.project_id = u.project_id AND e.target_file = u.file_path))""",
)


@query("directory_graph", "SELECT * FROM v_dir_edges")
def _(spark, sf):
    return graph.directory_edges(edges(spark, sf))


@query("entry_points", "SELECT * FROM v_entries")
def _(spark, sf):
    return graph.entry_points(corpus.units(spark, sf), edges(spark, sf))


# --- profiles --------------------------------------------------------------------------------------


@query(
    "project_stats",
    """SELECT project_id, CASE WHEN kind IS NOT NULL THEN 'kind' WHEN language IS NOT NULL THEN 'language' ELSE 'total' END AS facet,
      coalesce(kind, language, '') AS value, count(*) AS units, count(DISTINCT file_path) AS files FROM units
      GROUP BY GROUPING SETS ((project_id, kind), (project_id, language), (project_id))""",
)
def _(spark, sf):
    return profile.project_stats(corpus.units(spark, sf).select("project_id", "kind", "language", "file_path"))


@query(
    "file_graph_nodes",
    "SELECT project_id, file_path, count(*) AS unit_count, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM units GROUP BY ALL",
)
def _(spark, sf):
    return profile.file_nodes(corpus.units(spark, sf)).withColumn("kinds", F.array_join("kinds", "|"))


_DIR = q.dirname("file_path")


@query(
    "directory_graph_nodes",
    f"SELECT project_id, {_DIR} AS directory, count(DISTINCT file_path) AS file_count, count(*) AS unit_count FROM units GROUP BY ALL",
)
def _(spark, sf):
    return profile.directory_nodes(corpus.units(spark, sf))


views.register(
    "v_profiles",
    f"""SELECT project_id, directory, count(DISTINCT file_path) AS file_count,
      {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in profile.KINDS)},
      coalesce(array_to_string(list_slice(list(docstring ORDER BY file_path, start_line, id) FILTER (WHERE docstring <> ''), 1, 3), '|'), '') AS docstrings,
      (SELECT count(*) FROM v_dir_edges e WHERE e.project_id = u.project_id AND e.from_dir = u.directory) AS imports_from,
      (SELECT count(*) FROM v_dir_edges e WHERE e.project_id = u.project_id AND e.to_dir = u.directory) AS imported_by
      FROM (SELECT *, {_DIR} AS directory FROM units) u GROUP BY project_id, directory""",
)


def _profiles(spark, sf):
    return profile.directory_profile(corpus.units(spark, sf), graph.directory_edges(edges(spark, sf)))


@query("directory_profile", "SELECT * FROM v_profiles")
def _(spark, sf):
    return _profiles(spark, sf).withColumn("docstrings", F.array_join("docstrings", "|"))


@query(
    "directory_unit_names",
    f"SELECT project_id, {_DIR} AS directory, file_path, start_line, name FROM units WHERE kind IN ('function', 'class')",
)
def _(spark, sf):
    return profile.directory_unit_names(corpus.units(spark, sf))


@query(
    "codebase_structure",
    f"""SELECT project_id, count(*) AS units, count(DISTINCT file_path) AS files, count(DISTINCT {_DIR}) AS directories,
      (SELECT count(*) FROM v_dir_edges e WHERE e.project_id = u.project_id) AS directory_edges,
      (SELECT count(*) FROM v_entries e WHERE e.project_id = u.project_id) AS entry_points FROM units u GROUP BY project_id""",
)
def _(spark, sf):
    linked = edges(spark, sf)
    all_units = corpus.units(spark, sf)
    return profile.codebase_structure(all_units, graph.directory_edges(linked), graph.entry_points(all_units, linked))


@query(
    "summarizable_directories",
    """SELECT project_id, directory FROM v_profiles WHERE n_function + n_class + n_method + n_module > 2
      AND NOT (len(string_split(directory, '/')) >= 4 AND list_has_any(string_split(directory, '/'), ['lib', 'test']))""",
)
def _(spark, sf):
    return profile.summarizable(_profiles(spark, sf)).select("project_id", "directory")
