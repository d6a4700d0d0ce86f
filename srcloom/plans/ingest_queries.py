"""Registered queries for scanning, filtering and cutting files into units."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.operators import ingest, units
from srcloom.registry import query
from srcloom.sources import corpus, store

LIMITS = dict(max_files=30, max_file_bytes=9_000, max_total_bytes=60_000)

_EXCL = f"list_has_any(list_slice(string_split(file_path, '/'), 1, -2), {q.arr(dims.EXCLUDED_DIRS)})"
_DEPTH = "len(string_split(file_path, '/')) - 1"


def sensitive_sql(p: str) -> str:
    low = f"lower(replace({p}, '\\', '/'))"
    base = f"list_extract(list_filter(string_split({low}, '/'), lambda x: x <> ''), -1)"
    return (
        f"(list_has_any(string_split({low}, '/'), {q.arr(dims.SENSITIVE_DIRS)}) OR list_contains({q.arr(dims.SENSITIVE_NAMES)}, {base})"
        f" OR {q.m(base, '^' + chr(92) + '.env[.-]')} OR {q.m(base, dims.SENSITIVE_CONFIG)}"
        f" OR list_contains({q.arr(dims.SENSITIVE_EXTENSIONS)}, {q.ext(base)}))"
    )


_BASE = q.basename("file_path")
_INDEXABLE = (
    f"(NOT {_EXCL} AND list_contains({q.arr(dims.INDEX_EXTENSIONS)}, lower({q.ext('file_path')}))"
    f" AND NOT {q.m(_BASE, dims.LOCK_OR_SNAPSHOT, 'i')} AND NOT {q.m(_BASE, dims.INDEX_LOCKFILES, 'i')}"
    f" AND NOT {sensitive_sql('file_path')})"
)
views.register("v_scanned", f"SELECT project_id, file_path, bytes, {_DEPTH} > {dims.MAX_DEPTH} AS too_deep, content FROM tree_files WHERE {_INDEXABLE}")
views.register(
    "v_capped",
    "SELECT *, rank > " + str(LIMITS["max_files"]) + " AS over_file_limit FROM (SELECT project_id, file_path, bytes,"
    " row_number() OVER (PARTITION BY project_id ORDER BY file_path) AS rank, (sum(bytes) OVER (PARTITION BY project_id"
    " ORDER BY file_path ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bytes FROM v_scanned)",
)
views.register(
    "v_flags",
    f"""SELECT project_id, count(*) FILTER (WHERE {_INDEXABLE}) > {LIMITS['max_files']} AS hit_max_files,
      coalesce(bool_or({_DEPTH} > {dims.MAX_DEPTH} AND NOT list_has_any(list_slice(string_split(file_path, '/'), 1,
        least({_DEPTH}, {dims.MAX_DEPTH + 1})), {q.arr(dims.EXCLUDED_DIRS)})), false) AS hit_max_depth
      FROM tree_files GROUP BY project_id""",
)


@query("scan_repository", "SELECT project_id, file_path, bytes, too_deep FROM v_scanned")
def _(spark, sf):
    return ingest.scan(corpus.tree_files(spark, sf)).select("project_id", "file_path", "bytes", "too_deep")


def _capped(spark, sf):
    scanned = ingest.scan(corpus.tree_files(spark, sf)).select("project_id", "file_path", "bytes")
    return ingest.cap_files(scanned, LIMITS["max_files"])


@query("file_cap", "SELECT c.*, hit_max_files, hit_max_depth FROM v_capped c JOIN v_flags USING (project_id)")
def _(spark, sf):
    flags = ingest.limit_flags(corpus.tree_files(spark, sf), LIMITS["max_files"])
    return _capped(spark, sf).join(flags, "project_id")


_REC = f"""RECURSIVE fold AS (
  SELECT project_id, rank, file_path, bytes, CASE WHEN bytes > {LIMITS['max_file_bytes']} THEN 'oversized'
      WHEN bytes > {LIMITS['max_total_bytes']} THEN 'byte_budget' END AS skip_reason,
    CASE WHEN bytes > {LIMITS['max_file_bytes']} OR bytes > {LIMITS['max_total_bytes']} THEN 0 ELSE bytes END AS total
  FROM v_capped WHERE rank = 1
  UNION ALL
  SELECT c.project_id, c.rank, c.file_path, c.bytes, CASE WHEN c.bytes > {LIMITS['max_file_bytes']} THEN 'oversized'
      WHEN f.total + c.bytes > {LIMITS['max_total_bytes']} THEN 'byte_budget' END,
    f.total + CASE WHEN c.bytes > {LIMITS['max_file_bytes']} OR f.total + c.bytes > {LIMITS['max_total_bytes']} THEN 0 ELSE c.bytes END
  FROM fold f JOIN v_capped c ON c.project_id = f.project_id AND c.rank = f.rank + 1 WHERE NOT c.over_file_limit)"""
views.register(
    "v_budget",
    f"WITH {_REC} SELECT project_id, file_path, bytes, skip_reason FROM fold"
    " UNION ALL SELECT project_id, file_path, bytes, 'file_limit' FROM v_capped WHERE over_file_limit",
)


def _budgeted(spark, sf):
    return ingest.apply_byte_budget(_capped(spark, sf), LIMITS["max_file_bytes"], LIMITS["max_total_bytes"])


@query("size_and_byte_budget", "SELECT * FROM v_budget")
def _(spark, sf):
    return _budgeted(spark, sf)


@query(
    "index_warnings",
    f"""SELECT project_id, unnest({q.compact([
        f"CASE WHEN hit_max_files THEN 'Indexing reached the configured file limit ({LIMITS['max_files']} supported files). Some files were not indexed.' END",
        f"CASE WHEN hit_max_depth THEN 'Indexing reached the configured directory depth limit ({dims.MAX_DEPTH}). Deeply nested files may be omitted.' END",
        f"CASE WHEN big = 1 THEN '1 file was skipped because it exceeds' WHEN big > 1 THEN concat(big, ' files were skipped because they exceed') END || ' the per-file indexing limit ({LIMITS['max_file_bytes']} bytes).'",
        f"CASE WHEN over = 1 THEN '1 file was' WHEN over > 1 THEN concat(over, ' files were') END || ' skipped after the repository indexing byte budget ({LIMITS['max_total_bytes']} bytes) was reached.'",
    ])}) AS warning FROM v_flags LEFT JOIN (SELECT project_id, count(*) FILTER (WHERE skip_reason = 'oversized') AS big,
      count(*) FILTER (WHERE skip_reason = 'byte_budget') AS over FROM v_budget GROUP BY project_id) USING (project_id)""",
)
def _(spark, sf):
    flags = ingest.limit_flags(corpus.tree_files(spark, sf), LIMITS["max_files"])
    return ingest.index_warnings(flags, _budgeted(spark, sf), **LIMITS)


_UNSUP = [e for e in dims.LANGUAGE_LABELS if e not in dims.INDEX_EXTENSIONS]


@query(
    "unsupported_language_report",
    f"""SELECT project_id, extension, label, count(*) AS file_count, array_to_string(list_slice(list_sort(list(file_path)), 1, 3), '|') AS sample_files
      FROM (SELECT project_id, file_path, lower({q.ext('file_path')}) AS extension,
        {q.lit_map(f"lower({q.ext('file_path')})", dims.LANGUAGE_LABELS)} AS label FROM tree_files
        WHERE NOT {_EXCL} AND NOT {q.m('lower(file_path)', dims.MIGRATION_SQL)})
      WHERE list_contains({q.arr(_UNSUP)}, extension) GROUP BY ALL""",
)
def _(spark, sf):
    df = ingest.unsupported_languages(corpus.tree_files(spark, sf))
    return df.withColumn("sample_files", F.array_join("sample_files", "|"))


_REMAP = r"=\s*(lib/[^/'\"]+)"
_NESTED = "regexp_extract(file_path, '^((?:[^/]+/){0,3}[^/]+)/\\.git(?:/|\\z)', 1)"
views.register(
    "v_prefixes",
    f"""SELECT DISTINCT project_id, unnest(CASE
      WHEN file_path = '.gitmodules' THEN list_transform({q.exall('content', r'^\s*path\s*=\s*(.+)$', 1, 'm')}, lambda x: {q.trim('x')})
      WHEN file_path = 'foundry.toml' THEN {q.exall('content', _REMAP)}
      WHEN {_BASE} = 'foundry.toml' AND list_contains({q.arr(dims.FOUNDRY_SUBDIRS)}, {q.dirname('file_path')})
        THEN list_transform({q.exall('content', _REMAP)}, lambda x: concat({q.dirname('file_path')}, '/', x))
      WHEN file_path = 'remappings.txt' THEN {q.exall('content', r'=\s*(lib/[^/\s]+)', 1, 'm')}
      WHEN {_NESTED} <> '' AND NOT list_has_any(string_split({_NESTED}, '/'), {q.arr(dims.VENDOR_SCAN_SKIP_DIRS)}) THEN [{_NESTED}]
      ELSE CAST([] AS VARCHAR[]) END) AS prefix FROM tree_files""",
)


@query("vendored_prefixes", "SELECT * FROM v_prefixes")
def _(spark, sf):
    return ingest.vendored_prefixes(corpus.tree_files(spark, sf))


@query(
    "vendored_flag",
    """SELECT project_id, file_path, EXISTS (SELECT 1 FROM v_prefixes v WHERE v.project_id = t.project_id
      AND (t.file_path = v.prefix OR starts_with(t.file_path, v.prefix || '/'))) AS is_vendored FROM tree_files t""",
)
def _(spark, sf):
    tree = corpus.tree_files(spark, sf)
    return ingest.flag_vendored(tree.select("project_id", "file_path"), ingest.vendored_prefixes(tree))


@query(
    "text_module_units",
    f"""SELECT project_id, file_path, substr({q.ext('file_path')}, 2) AS language, 'module' AS kind, {_BASE} AS name, md5(content) AS code,
      1 AS start_line, len(string_split(content, chr(10))) AS end_line FROM tree_files
      WHERE list_contains({q.arr(dims.TEXT_EXTENSIONS)}, {q.ext('file_path')})""",
)
def _(spark, sf):
    return units.text_modules(corpus.tree_files(spark, sf)).withColumn("code", F.md5("code"))


@query(
    "markdown_units",
    f"""SELECT project_id, file_path, 'markdown' AS language, 'module' AS kind,
      CASE WHEN {q.m('content', r'^#\s+(.+)$', 'm')} THEN left({q.trim(q.ex('content', r'^#\s+(.+)$', 1, 'm'))}, 120) ELSE {q.stem('file_path')} END AS name,
      md5(content) AS code, 1 AS start_line, len(string_split(content, chr(10))) AS end_line FROM tree_files
      WHERE list_contains({q.arr(dims.DOC_EXTENSIONS)}, {q.ext('file_path')}) AND {q.trim('content')} <> ''""",
)
def _(spark, sf):
    return units.markdown_modules(corpus.tree_files(spark, sf)).withColumn("code", F.md5("code"))


def _decl_sql() -> str:
    """Number of the first rule of the line's language that finds a usable name."""
    groups = []
    for g, table in dims.DECLARATIONS.items():
        whens = " ".join(
            f"WHEN {q.m('line', p)} AND NOT list_contains({q.arr(dims.CONTROL_WORDS)}, {q.ex('line', p, 2)}) THEN {i}"
            for i, (_, p) in enumerate(table)
        )
        groups.append(f"WHEN {q.s(g)} THEN CASE {whens} END")
    return f"CASE grp {' '.join(groups)} END"


def _decl_part(part) -> str:
    """Value taken from the rule that was found."""
    groups = []
    for g, table in dims.DECLARATIONS.items():
        whens = " ".join(f"WHEN {i} THEN {part(kind, p)}" for i, (kind, p) in enumerate(table))
        groups.append(f"WHEN {q.s(g)} THEN CASE rule {whens} END")
    return f"CASE grp {' '.join(groups)} END"


_EXT = q.ext("file_path")
views.register(
    "v_tree_lines",
    f"""SELECT project_id, file_path, {q.lit_map(_EXT, dims.LANGUAGE_GROUPS)} AS grp, i AS line_no, ls[i] AS line, len(ls) AS n_lines
      FROM (SELECT project_id, file_path, string_split(content, chr(10)) AS ls FROM tree_files), range(1, len(ls) + 1) r(i)""",
)
views.register(
    "v_decl",
    f"""SELECT project_id, file_path, line_no, n_lines, {_decl_part(lambda k, p: q.s(k))} AS kind, {_decl_part(lambda k, p: q.ex('line', p, 2))} AS name,
      {_decl_part(lambda k, p: f"length({q.ex('line', p, 1)})")} AS indent, {q.m('line', dims.EXPORT_LINE)} AS exported
      FROM (SELECT *, {_decl_sql()} AS rule FROM v_tree_lines WHERE grp IS NOT NULL) WHERE rule IS NOT NULL""",
)
views.register(
    "v_decl_units",
    f"""SELECT project_id, file_path, {q.lit_map(_EXT, dims.GROUP_LANGUAGES)} AS language,
      CASE WHEN kind = 'function' AND parent IS NOT NULL THEN 'method' ELSE kind END AS kind, name, line_no AS start_line, end_line,
      CASE WHEN kind = 'method' OR (kind = 'function' AND parent IS NOT NULL) THEN parent END AS parent_name, exported FROM (
      SELECT d.*, coalesce((SELECT min(o.line_no) - 1 FROM v_decl o WHERE o.project_id = d.project_id AND o.file_path = d.file_path
          AND o.line_no > d.line_no AND o.indent <= d.indent), d.n_lines) AS end_line,
        (SELECT arg_max(o.name, o.line_no) FROM v_decl o WHERE o.project_id = d.project_id AND o.file_path = d.file_path
          AND o.line_no < d.line_no AND o.indent < d.indent AND o.kind = 'class') AS parent FROM v_decl d)""",
)


@query(
    "declaration_scan",
    """SELECT u.*, md5((SELECT string_agg(line, chr(10) ORDER BY line_no) FROM v_tree_lines l WHERE l.project_id = u.project_id
        AND l.file_path = u.file_path AND l.line_no BETWEEN u.start_line AND u.end_line)) AS code FROM v_decl_units u""",
)
def _(spark, sf):
    return units.declarations(corpus.tree_files(spark, sf)).withColumn("code", F.md5("code"))


def _import_sql() -> str:
    whens = " ".join(f"WHEN {q.s(g)} THEN {q.exall('content', p, 0, 'm')}" for g, p in dims.IMPORT_LINES.items())
    return f"CASE grp {whens} ELSE CAST([] AS VARCHAR[]) END"


@query(
    "import_statements",
    f"""SELECT project_id, file_path, array_to_string({q.distinct('xs')}, '|') AS imports FROM (SELECT project_id, file_path, {_import_sql()} AS xs
      FROM (SELECT *, {q.lit_map(_EXT, dims.LANGUAGE_GROUPS)} AS grp FROM tree_files))""",
)
def _(spark, sf):
    col = units.import_statements(F.col("file_path"), F.col("content"))
    return corpus.tree_files(spark, sf).select("project_id", "file_path", F.array_join(col, "|").alias("imports"))


@query(
    "called_functions",
    f"""SELECT project_id, file_path, array_to_string({q.distinct('xs')}, '|') AS calls FROM (SELECT project_id, file_path,
      list_filter(flatten(list_transform({q.exall('content', dims.CALL)}, lambda n: [n, regexp_extract(n, '[^.]*$')])),
        lambda n: n <> '' AND NOT list_contains({q.arr(dims.CONTROL_WORDS)}, n)) AS xs FROM tree_files)""",
)
def _(spark, sf):
    col = units.called_functions(F.col("content"))
    return corpus.tree_files(spark, sf).select("project_id", "file_path", F.array_join(col, "|").alias("calls"))


def _decl_units(spark, sf):
    """Declared units with the export list and vendored flag the anchors need."""
    tree = corpus.tree_files(spark, sf)
    found = units.declarations(tree).withColumn(
        "exported_names", F.when(F.col("exported"), F.array("name")).otherwise(F.array().cast("array<string>"))
    )
    return ingest.flag_vendored(found, ingest.vendored_prefixes(tree))


views.register(
    "v_flagged_units",
    """SELECT u.*, EXISTS (SELECT 1 FROM v_prefixes v WHERE v.project_id = u.project_id
      AND (u.file_path = v.prefix OR starts_with(u.file_path, v.prefix || '/'))) AS is_vendored FROM v_decl_units u""",
)
views.register(
    "v_anchors",
    f"""SELECT u.project_id, u.file_path, arg_min(language, (start_line, name)) AS language, 'module' AS kind, {q.stem('u.file_path')} AS name,
      1 AS start_line, any_value(t.n) AS end_line, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE exported)), '|') AS exported_names,
      bool_and(is_vendored) AS is_vendored, any_value(t.code) AS code
      FROM v_flagged_units u JOIN (SELECT project_id, file_path, len(string_split(content, chr(10))) AS n, md5(content) AS code FROM tree_files) t
        ON t.project_id = u.project_id AND t.file_path = u.file_path
      GROUP BY u.project_id, u.file_path HAVING NOT bool_or(kind = 'module' AND start_line = 1)""",
)


@query(
    "ensure_module_anchor",
    "SELECT project_id, file_path, language, kind, name, start_line, end_line, coalesce(exported_names, '') AS exported_names, is_vendored, code FROM v_anchors",
)
def _(spark, sf):
    df = units.module_anchors(_decl_units(spark, sf), corpus.tree_files(spark, sf))
    return df.withColumns({"code": F.md5("code"), "exported_names": F.array_join("exported_names", "|")})


# Units without their modules; only files of good quality bring their text.
_LISTED = {"exported_names": "exported_names", "imports": "imports", "called_functions": "called_functions"}


@query(
    "rebuild_module_anchor",
    f"""SELECT project_id, file_path, language, name, end_line, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in _LISTED)}, docstring, is_vendored, md5(code) AS code FROM (
      SELECT u.project_id, u.file_path, arg_min(language, (start_line, u.name)) AS language, {q.stem('u.file_path')} AS name, coalesce(any_value(n), max(end_line)) AS end_line,
        {', '.join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in _LISTED)}, arg_min({{'d': docstring}}, (start_line, u.name)).d AS docstring, bool_and(u.is_vendored) AS is_vendored,
        coalesce(any_value(f.content), string_agg(u.code, chr(10) || chr(10) ORDER BY start_line, u.name)) AS code
      FROM (SELECT * FROM units WHERE kind <> 'module') u LEFT JOIN (SELECT project_id, file_path, content, len(string_split(content, chr(10))) AS n FROM files JOIN labels USING (doc_id) WHERE quality = 1) f USING (project_id, file_path)
      GROUP BY u.project_id, u.file_path)""",
)
def _(spark, sf):
    good = corpus.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    files = corpus.files(spark, sf).join(good, "doc_id", "left_semi")
    found = units.module_anchors(corpus.units(spark, sf).filter("kind <> 'module'"), files)
    shown = {c: F.array_join(c, "|") for c in _LISTED}
    columns = ["project_id", "file_path", "language", "name", "end_line", *_LISTED, "docstring", "is_vendored", "code"]
    return found.withColumns({**shown, "code": F.md5("code")}).select(columns)


@query(
    "index_stats",
    """SELECT project_id, count(*) FILTER (WHERE kind = 'function') AS n_function, count(*) FILTER (WHERE kind = 'class') AS n_class,
      count(*) FILTER (WHERE kind = 'method') AS n_method, count(*) FILTER (WHERE kind = 'module') AS n_module,
      count(*) FILTER (WHERE is_vendored) AS vendored_units, count(DISTINCT file_path) FILTER (WHERE is_vendored) AS vendored_files,
      coalesce(any_value(a.n), 0) AS anchors FROM v_flagged_units u LEFT JOIN (SELECT project_id, count(*) AS n FROM v_anchors GROUP BY 1) a USING (project_id)
      GROUP BY project_id""",
)
def _(spark, sf):
    found = _decl_units(spark, sf)
    return units.index_stats(found, units.module_anchors(found, corpus.tree_files(spark, sf)))


# --- stored units, project bookkeeping ---------------------------------------------------


@query(
    "load_units_tolerant",
    """SELECT session_id, CASE event_case WHEN 0 THEN 'src/index.ts|README.md' ELSE '' END AS strict_list,
      CASE event_case WHEN 0 THEN 'src/index.ts|README.md' WHEN 1 THEN 'src/index.ts' WHEN 2 THEN 'README.md' ELSE '' END AS lenient_list
      FROM (SELECT *, CASE WHEN json_valid(source_files_json) THEN
          CASE WHEN source_files_json = '[]' THEN 4
            WHEN list_contains(json_type_list, 'NULL') THEN 2 WHEN list_contains(json_type_list, 'UBIGINT') THEN 1 ELSE 0 END ELSE 3 END AS event_case
        FROM (SELECT *, CASE WHEN json_valid(source_files_json) THEN list_transform(CAST(TRY_CAST(source_files_json AS JSON) AS JSON[]), lambda x: coalesce(json_type(x), 'NULL')) END AS json_type_list FROM sessions))""",
)
def _(spark, sf):
    c = F.col("source_files_json")
    return corpus.sessions(spark, sf).select(
        "session_id",
        F.array_join(store.strict_string_array(c), "|").alias("strict_list"),
        F.array_join(store.lenient_string_array(c), "|").alias("lenient_list"),
    )


# A second index of a part of the projects: some without vendored code, some under a new id, some without any unit.
_AGAIN, _MOVED, _EMPTIED = "project_id % 3 = 0", "project_id % 3 = 1", "project_id % 7 = 6"
_NEW_ID = 1_000_000
views.register(
    "v_indexed",
    f"""SELECT project_id, file_path, code, imports FROM units WHERE NOT ({_EMPTIED}) AND NOT ({_MOVED}) AND NOT ({_AGAIN} AND is_vendored)
      UNION ALL SELECT project_id + {_NEW_ID}, file_path, code, imports FROM units WHERE NOT ({_EMPTIED}) AND {_MOVED} AND kind = 'module'""",
)


@query(
    "replace_project_index",
    f"""SELECT p.project_id, repo_path, coalesce(u.unit_count, 0) AS unit_count, coalesce(u.file_count, 0) AS file_count, coalesce(u.n_chars, 0) AS n_chars, coalesce(e.n_edges, 0) AS n_edges
      FROM (SELECT DISTINCT CASE WHEN {_MOVED} AND NOT ({_EMPTIED}) THEN project_id + {_NEW_ID} ELSE project_id END AS project_id, concat('/repos/', project_id) AS repo_path FROM units) p
      LEFT JOIN (SELECT project_id, count(*) AS unit_count, count(DISTINCT file_path) AS file_count, CAST(sum(length(code)) AS BIGINT) AS n_chars FROM v_indexed GROUP BY project_id) u USING (project_id)
      LEFT JOIN (SELECT project_id, count(*) AS n_edges FROM (SELECT DISTINCT project_id, file_path, unnest(imports) AS statement FROM v_indexed) GROUP BY project_id) e USING (project_id)""",
)
def _(spark, sf):
    from uuid import uuid4

    from srcloom.staging import shared_folder

    folder = f"{shared_folder(spark)}/index-{uuid4().hex}"
    units = corpus.units(spark, sf)

    def edges(of):
        statement = F.explode("imports").alias("import_statement")
        return of.select("project_id", F.col("file_path").alias("source_file"), statement).distinct()

    def projects(of, path_id="project_id"):
        path = F.concat(F.lit("/repos/"), F.col(path_id).cast("string"))
        return of.select("project_id", path.alias("repo_path")).distinct()

    store.replace_index(folder, projects(units), units, edges(units))
    emptied = units.filter(_EMPTIED)
    rest = units.filter(f"not ({_EMPTIED})")
    moved = rest.filter(_MOVED).withColumn("old_id", F.col("project_id")).withColumn("project_id", F.col("project_id") + _NEW_ID)
    again = rest.filter(_AGAIN)
    named = projects(emptied).unionByName(projects(again)).unionByName(projects(moved, "old_id"))
    fresh = again.filter("not is_vendored").unionByName(moved.drop("old_id").filter("kind = 'module'"))
    store.replace_index(folder, named, fresh, edges(fresh))
    now = store.read_index(spark, folder, units.schema, edges(units).schema)
    sizes = now["units"].groupBy("project_id").agg(
        F.count("*").alias("units_read"), F.count_distinct("file_path").alias("files_read"), F.sum(F.length("code")).alias("n_chars")
    )
    links = now["edges"].groupBy("project_id").agg(F.count("*").alias("n_edges"))
    rows = now["projects"].join(sizes, "project_id", "left").join(links, "project_id", "left").fillna(0)
    # What is read agrees with the counts that the last replacement wrote.
    return rows.filter("unit_count = units_read and file_count = files_read").select(
        "project_id", "repo_path", "unit_count", "file_count", "n_chars", "n_edges"
    )


# Units as lines of JSON, one in two of them damaged in some way.
_DAMAGE = "(start_line // 8 + project_id) % 7"
_NO_LIST = "imports is not a list of strings"


@query(
    "load_units_json",
    f"""SELECT CASE WHEN d NOT IN (0, 3) THEN id END AS id, CASE WHEN d <> 0 THEN file_path END AS file_path, CASE WHEN d <> 0 THEN md5(code) END AS code, CASE WHEN d NOT IN (0, 2) THEN start_line END AS start_line,
      CASE WHEN d <> 0 THEN end_line END AS end_line, CASE WHEN d IN (0, 1, 5) THEN '' ELSE array_to_string(imports, '|') END AS imports, CASE WHEN d <> 0 THEN array_to_string(called_functions, '|') ELSE '' END AS called_functions,
      d <> 0 AND is_vendored AS is_vendored, CASE d WHEN 0 THEN 'not a JSON object' WHEN 1 THEN '{_NO_LIST}' WHEN 2 THEN 'startLine is not a number' WHEN 3 THEN 'id is missing' WHEN 5 THEN '{_NO_LIST}' ELSE '' END AS problems
      FROM (SELECT *, {_DAMAGE} AS d FROM units)""",
)
def _(spark, sf):
    from uuid import uuid4

    from srcloom.staging import shared_folder

    units = corpus.units(spark, sf).withColumn("d", F.expr(_DAMAGE.replace("//", "div")))
    d = F.col("d")
    listed = F.to_json("imports")
    changed = {
        "imports": F.when(d == 1, "no list").when(d == 5, '["a", 7]').otherwise(listed),
        "start_line": F.when(d == 2, "x").otherwise(F.col("start_line").cast("string")),
        "id": F.when(d != 3, F.col("id")),
        "is_vendored": F.when(d == 4, F.col("is_vendored").cast("int").cast("string")).otherwise(F.col("is_vendored").cast("string")),
    }
    fields = [changed.get(to, F.col(to)).alias(name) for name, to in store.UNIT_FIELDS.items()]
    line = F.to_json(F.struct(*fields))
    path = f"{shared_folder(spark)}/units-{uuid4().hex}"
    units.select(F.when(d == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    found = store.load_units(spark, path)
    shown = {c: F.array_join(c, "|") for c in ("imports", "called_functions", "problems")}
    return found.withColumns({**shown, "code": F.md5("code")}).select(
        "id", "file_path", "code", "start_line", "end_line", "imports", "called_functions", "is_vendored", "problems"
    )


_DELETED = "SELECT DISTINCT project_id FROM sessions WHERE trim(brief) = '' AND generation_truncated"


@query(
    "delete_cascade",
    f"""SELECT 'units' AS child, count(*) AS n FROM units WHERE project_id NOT IN ({_DELETED})
      UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE project_id NOT IN ({_DELETED})
      UNION ALL SELECT 'messages', count(*) FROM messages m WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = m.session_id AND s.project_id IN ({_DELETED}))
      UNION ALL SELECT 'kg_nodes', count(*) FROM kg_nodes WHERE project_id NOT IN ({_DELETED})""",
)
def _(spark, sf):
    sessions = corpus.sessions(spark, sf)
    gone = sessions.filter("trim(brief) = '' and generation_truncated").select("project_id").distinct()
    kept = store.delete_projects(
        gone,
        {
            "units": corpus.units(spark, sf),
            "sessions": sessions,
            "messages": corpus.messages(spark, sf),
            "kg_nodes": corpus.kg_nodes(spark, sf),
        },
    )
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "upsert_graph",
    """SELECT project_id, arg_max(brief, (created_at, session_id)) AS graph, max(created_at) AS generated_at FROM sessions GROUP BY project_id""",
)
def _(spark, sf):
    s = corpus.sessions(spark, sf).selectExpr("project_id", "brief as graph", "created_at as generated_at", "session_id as version")
    old, new = s.filter("graph = '   '"), s.filter("graph <> '   '")
    return store.upsert_latest(old, new).select("project_id", "graph", "generated_at")
