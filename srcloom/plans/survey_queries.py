"""Registered queries for the survey inventory, file selection and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.operators import ingest, survey
from srcloom.plans.ingest_queries import _DEPTH, _EXCL, sensitive_sql
from srcloom.plans.text_queries import redact_sql
from srcloom.registry import query
from srcloom.sources import corpus
from srcloom.staging import shared

_B = q.basename("file_path")
_X = f"lower({q.ext('file_path')})"
_SURVEYABLE = (
    f"(NOT {_EXCL} AND list_contains({q.arr(dims.SURVEY_EXTENSIONS)}, {_X}) AND NOT {q.m(_B, dims.LOCK_OR_SNAPSHOT, 'i')}"
    f" AND NOT {q.m(_B, dims.SURVEY_LOCKFILES, 'i')} AND NOT {q.m(_B, dims.SURVEY_BINARIES, 'i')} AND NOT {sensitive_sql('file_path')})"
)
# The scores of v_scored come from the raw text; the inventory scores the redacted text.
_base = views.VIEWS["v_signals"].replace("FROM tree_files", "FROM v_surveyed")
views.register(
    "v_surveyed",
    f"SELECT doc_id, project_id, file_path, bytes, {redact_sql('file_path', 'content')} AS content FROM tree_files WHERE {_SURVEYABLE}",
)
views.register("v_survey_signals", _base)
views.register("v_survey_scored", views.VIEWS["v_scored"].replace("v_signals", "v_survey_signals"))
views.register(
    "v_inventory",
    f"""SELECT project_id, file_path, bytes, {q.lit_map(_X, dims.SURVEY_LABELS, f"upper(regexp_replace({_X}, '^[.]', ''))")} AS language,
      list_contains({q.arr(dims.INDEX_EXTENSIONS)}, {_X}) AS supported, is_doc AS documentation, entry_score, doc_score, bytes > {dims.MAX_FILE_BYTES} AS oversized,
      EXISTS (SELECT 1 FROM v_prefixes v WHERE v.project_id = s.project_id AND (s.file_path = v.prefix OR starts_with(s.file_path, v.prefix || '/'))) AS is_vendored FROM v_survey_scored s""",
)


def inventory(spark, sf):
    def build():
        tree = corpus.tree_files(spark, sf)
        return survey.inventory(tree, ingest.vendored_prefixes(tree))

    return shared(spark, sf, "inventory", build)


@query("inventory", "SELECT * FROM v_inventory")
def _(spark, sf):
    tree = corpus.tree_files(spark, sf)
    return survey.inventory(tree, ingest.vendored_prefixes(tree))


def _ranked_sql(kind):
    score, extra = ("entry_score", "") if kind == "candidate" else ("doc_score", " AND doc_score > 0")
    return f"""SELECT project_id, file_path, {score} AS score, row_number() OVER (PARTITION BY project_id ORDER BY {score} DESC, file_path) AS rank
      FROM v_inventory WHERE NOT is_vendored{extra}"""


views.register("v_top_candidates", _ranked_sql("candidate"))
views.register("v_top_documents", _ranked_sql("documentation"))


@query("inventory_candidates", "SELECT * FROM v_top_candidates")
def _(spark, sf):
    return survey.ranked(inventory(spark, sf), "candidate").select("project_id", "file_path", F.col("entry_score").alias("score"), "rank")


@query("inventory_documents", "SELECT * FROM v_top_documents")
def _(spark, sf):
    return survey.ranked(inventory(spark, sf), "documentation").select("project_id", "file_path", F.col("doc_score").alias("score"), "rank")


@query(
    "inventory_language_summary",
    "SELECT project_id, language, count(*) AS file_count, sum(bytes)::BIGINT AS bytes, bool_or(supported) AS supported FROM v_inventory GROUP BY ALL",
)
def _(spark, sf):
    return survey.language_summary(inventory(spark, sf))


@query(
    "inventory_totals",
    """SELECT project_id, count(*) AS scanned, count(*) FILTER (WHERE oversized) AS oversized, count(*) FILTER (WHERE supported) AS supported,
      count(*) FILTER (WHERE NOT supported) AS unsupported FROM v_inventory GROUP BY project_id""",
)
def _(spark, sf):
    return survey.inventory_totals(inventory(spark, sf))


# Quality labels stand for planned requests, toxicity labels for files already read.
views.register("v_inspected", "SELECT DISTINCT project_id, file_path FROM tree_files JOIN labels USING (doc_id) WHERE toxic = 1")


def _inspected(spark, sf):
    toxic = corpus.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return corpus.tree_files(spark, sf).select("doc_id", "project_id", "file_path").join(toxic, "doc_id", "left_semi").drop("doc_id")


@query("select_survey_files")
def _(spark, sf):
    labelled = corpus.tree_files(spark, sf).select("doc_id", "project_id", "file_path", "bytes").join(corpus.table(spark, sf, "labels"), "doc_id")
    asked = labelled.filter("quality = 1").select("project_id", "file_path", (F.col("bytes") % 7).alias("priority"))
    unknown = labelled.filter("quality = 0").select(
        "project_id", F.concat("file_path", F.lit(".missing")).alias("file_path"), F.lit(9).cast("bigint").alias("priority")
    )
    return survey.select_files(inventory(spark, sf), asked.unionByName(unknown), _inspected(spark, sf))


@query(
    "select_validation_files",
    f"""SELECT * FROM (SELECT project_id, file_path, row_number() OVER (PARTITION BY project_id ORDER BY tier, place, file_path) AS pos FROM (
      SELECT project_id, file_path, min((tier, place))[1] AS tier, min((tier, place))[2] AS place FROM (
        SELECT project_id, file_path, 0 AS tier, 0 AS place FROM v_inventory WHERE NOT is_vendored AND (project_id, file_path) IN (SELECT (project_id, file_path) FROM v_inspected)
          AND (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM kg_sources)
        UNION ALL SELECT project_id, file_path, 1, rank FROM v_top_candidates WHERE (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM v_inspected)
        UNION ALL SELECT project_id, file_path, 2, rank FROM v_top_documents WHERE NOT ((project_id, file_path) IN (SELECT (project_id, file_path) FROM v_inspected)
          AND (project_id, file_path) IN (SELECT (project_id, file_path) FROM kg_sources))) GROUP BY ALL)) WHERE pos <= {dims.SURVEY_VALIDATION_FILES}""",
)
def _(spark, sf):
    return survey.validation_files(inventory(spark, sf), _inspected(spark, sf), corpus.kg_sources(spark, sf))


# --- knowledge graph ----------------------------------------------------------------------------------

views.register(
    "v_source_counts",
    """SELECT project_id, owner_id, count(*) FILTER (WHERE start_line >= 1 AND end_line >= start_line) AS n_sources,
      count(*) FILTER (WHERE NOT (start_line >= 1 AND end_line >= start_line)) AS bad_sources FROM kg_sources GROUP BY ALL""",
)
_TYPES, _ETYPES, _CONF = q.arr(dims.NODE_TYPES), q.arr(dims.EDGE_TYPES), q.arr(dims.CONFIDENCES)


def _node_errors(table):
    return f"""SELECT n.*, coalesce(s.n_sources, 0) AS n_sources, {q.compact([
        "CASE WHEN coalesce(trim(label), '') = '' THEN 'label is required' END",
        "CASE WHEN coalesce(trim(summary), '') = '' THEN 'summary is required' END",
        f"CASE WHEN NOT coalesce(list_contains({_TYPES}, type), false) THEN 'type is invalid' END",
        f"CASE WHEN confidence IS NULL OR NOT list_contains({_CONF}, confidence) THEN 'confidence is invalid' END",
        "CASE WHEN s.bad_sources > 0 THEN 'source range is invalid' END",
        "CASE WHEN coalesce(type, '') <> 'risk' AND coalesce(s.n_sources, 0) = 0 THEN 'sources must include evidence' END",
        "CASE WHEN count(*) OVER (PARTITION BY n.project_id, n.node_id) > 1 THEN 'node ids must be unique' END",
    ])} AS errors FROM {table} n LEFT JOIN v_source_counts s ON s.project_id = n.project_id AND s.owner_id = n.node_id"""


views.register("v_node_errors", _node_errors("kg_nodes"))
views.register(
    "v_edge_errors",
    f"""SELECT e.*, coalesce(s.n_sources, 0) AS n_sources, {q.compact([
        f"CASE WHEN NOT list_contains({_ETYPES}, type) THEN 'type is invalid' END",
        "CASE WHEN NOT EXISTS (SELECT 1 FROM v_known_nodes k WHERE k.project_id = e.project_id AND k.node_id = e.from_id) THEN 'from must reference a known node' END",
        "CASE WHEN NOT EXISTS (SELECT 1 FROM v_known_nodes k WHERE k.project_id = e.project_id AND k.node_id = e.to_id) THEN 'to must reference a known node' END",
        f"CASE WHEN confidence IS NULL OR NOT list_contains({_CONF}, confidence) THEN 'confidence is invalid' END",
        "CASE WHEN s.bad_sources > 0 THEN 'source range is invalid' END",
        "CASE WHEN coalesce(s.n_sources, 0) = 0 THEN 'sources must include evidence' END",
        "CASE WHEN count(*) OVER (PARTITION BY e.project_id, e.edge_id) > 1 THEN 'edge ids must be unique' END",
    ])} AS errors FROM kg_edges e LEFT JOIN v_source_counts s ON s.project_id = e.project_id AND s.owner_id = e.edge_id""",
)
views.register(
    "v_known_nodes", f"SELECT DISTINCT project_id, node_id FROM kg_nodes WHERE list_contains({_TYPES}, type) AND confidence IS NOT NULL"
)


@query(
    "validate_graph",
    """SELECT project_id, 'node' AS item, node_id AS item_id, unnest(errors) AS error FROM v_node_errors
      UNION ALL SELECT project_id, 'edge', edge_id, unnest(errors) FROM v_edge_errors""",
)
def _(spark, sf):
    return survey.validate_graph(corpus.kg_nodes(spark, sf), corpus.kg_edges(spark, sf), corpus.kg_sources(spark, sf))


# Customers stand for a later observation of the same node ids.
_UPDATE = """CAST(floor(c_custkey / 25) AS BIGINT) AS project_id, concat('n', c_custkey) AS node_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'area' WHEN 'MACHINERY' THEN 'workflow'
  WHEN 'HOUSEHOLD' THEN 'state' WHEN 'AUTOMOBILE' THEN 'risk' ELSE 'other' END AS type, c_name AS label, concat('Seen as ', c_mktsegment) AS summary, 'high' AS confidence"""
views.register("v_kg_update", f"SELECT {_UPDATE} FROM customer")
views.register("v_update_errors", _node_errors("v_kg_update"))
_NC = "project_id, node_id, type, label, summary, confidence"


@query(
    "merge_graph",
    f"""SELECT {_NC}, 'kept' AS outcome FROM kg_nodes WHERE (project_id, node_id) NOT IN (SELECT (project_id, node_id) FROM v_update_errors WHERE len(errors) = 0)
      UNION ALL SELECT {_NC}, CASE WHEN len(errors) = 0 THEN 'updated' ELSE 'rejected' END FROM v_update_errors""",
)
def _(spark, sf):
    update = corpus.table(spark, sf, "customer").selectExpr(*[x.strip() for x in _split_columns(_UPDATE)])
    return survey.merge_nodes(corpus.kg_nodes(spark, sf), update, corpus.kg_sources(spark, sf))


def _split_columns(text):
    """Column list split at the commas that stand outside parentheses."""
    out, depth, part = [], 0, ""
    for ch in text.replace("\n", " "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


# A second observation of the graph: customers are nodes, parts are edges between node ids.
_EDGE_UPDATE = """CAST(floor(p_partkey / 25) AS BIGINT) AS project_id, concat('e', p_partkey) AS edge_id, CASE p_partkey % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'supports' WHEN 2 THEN 'depends_on' ELSE 'near' END AS type,
  concat('n', p_partkey) AS from_id, concat('n', p_partkey + 1 + p_size % 4) AS to_id, 'medium' AS confidence, p_partkey AS ord"""
views.register("v_kg_edge_update", f"SELECT {_EDGE_UPDATE} FROM part")
views.register("v_good_nodes", "SELECT project_id, node_id, type, label, summary, confidence FROM v_node_errors WHERE len(errors) = 0")
views.register(
    "v_good_edges",
    f"""SELECT project_id, edge_id, type, from_id, to_id, confidence FROM kg_edges e JOIN v_source_counts s USING (project_id) WHERE s.owner_id = e.edge_id AND s.n_sources > 0 AND s.bad_sources = 0 AND list_contains({_ETYPES}, type)
      AND list_contains({_CONF}, confidence) AND (project_id, from_id) IN (SELECT (project_id, node_id) FROM v_good_nodes) AND (project_id, to_id) IN (SELECT (project_id, node_id) FROM v_good_nodes)""",
)
views.register("v_settled_ids", "SELECT project_id, node_id FROM v_good_nodes UNION SELECT project_id, node_id FROM v_update_errors WHERE len(errors) = 0")
views.register(
    "v_edge_update_errors",
    f"""SELECT e.*, {q.compact([
        f"CASE WHEN NOT list_contains({_ETYPES}, type) THEN 'type is invalid' END",
        "CASE WHEN (e.project_id, e.from_id) NOT IN (SELECT (project_id, node_id) FROM v_settled_ids) THEN 'from must reference a known node' END",
        "CASE WHEN (e.project_id, e.to_id) NOT IN (SELECT (project_id, node_id) FROM v_settled_ids) THEN 'to must reference a known node' END",
        "CASE WHEN s.bad_sources > 0 THEN 'source range is invalid' END",
        "CASE WHEN coalesce(s.n_sources, 0) = 0 THEN 'sources must include evidence' END",
    ])} AS errors FROM v_kg_edge_update e LEFT JOIN v_source_counts s ON s.project_id = e.project_id AND s.owner_id = e.edge_id""",
)
_NEW_NODE = "(project_id, node_id) IN (SELECT (project_id, node_id) FROM v_good_nodes)"
_NEW_EDGE = "(project_id, edge_id) IN (SELECT (project_id, edge_id) FROM v_good_edges)"
_BASE_WARNINGS = "SELECT project_id, concat('Bad source in ', owner_id) AS warning, -2 AS tier, ord, concat('Bad source in ', owner_id) AS id FROM kg_sources WHERE end_line < start_line"


@query(
    "merge_graph_update",
    f"""SELECT project_id, 'node' AS part, node_id AS item, 'kept' AS outcome, label AS detail FROM v_good_nodes WHERE (project_id, node_id) NOT IN (SELECT (project_id, node_id) FROM v_update_errors WHERE len(errors) = 0)
      UNION ALL SELECT project_id, 'node', node_id, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN {_NEW_NODE} THEN 'updated' ELSE 'added' END, label FROM v_update_errors
      UNION ALL SELECT project_id, 'edge', edge_id, 'kept', concat(from_id, '>', to_id) FROM v_good_edges WHERE (project_id, edge_id) NOT IN (SELECT (project_id, edge_id) FROM v_edge_update_errors WHERE len(errors) = 0)
      UNION ALL SELECT project_id, 'edge', edge_id, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN {_NEW_EDGE} THEN 'updated' ELSE 'added' END, concat(from_id, '>', to_id) FROM v_edge_update_errors
      UNION ALL SELECT project_id, 'inspected', file_path, '', CAST(row_number() OVER (PARTITION BY project_id ORDER BY tier, ord, file_path) AS VARCHAR) FROM (SELECT project_id, file_path, min((tier, ord))[1] AS tier, min((tier, ord))[2] AS ord FROM (
        SELECT project_id, file_path, -2 AS tier, 0 AS ord FROM v_inspected UNION ALL SELECT project_id, file_path, -1, ord FROM kg_sources) GROUP BY ALL)
      UNION ALL SELECT project_id, 'warning', warning, '', CAST(row_number() OVER (PARTITION BY project_id ORDER BY spot, warning) AS VARCHAR) FROM (SELECT project_id, warning, min((tier, ord, id)) AS spot FROM ({_BASE_WARNINGS}
        UNION ALL SELECT project_id, concat('Unclear role of ', label), -1, CAST(substr(node_id, 2) AS BIGINT), concat('Unclear role of ', label) FROM v_kg_update WHERE type = 'other'
        UNION ALL SELECT project_id, concat('Rejected full graph update: ', unnest(errors)), 0, CAST(substr(node_id, 2) AS BIGINT), node_id FROM v_update_errors
        UNION ALL SELECT project_id, concat('Rejected full graph update: ', unnest(errors)), 1, ord, edge_id FROM v_edge_update_errors
        UNION ALL SELECT project_id, concat('Rejected graph node ', node_id, ': ', array_to_string(errors, '; ')), 2, CAST(substr(node_id, 2) AS BIGINT), node_id FROM v_update_errors WHERE len(errors) > 0
        UNION ALL SELECT project_id, concat('Rejected graph edge ', edge_id, ': ', array_to_string(errors, '; ')), 3, ord, edge_id FROM v_edge_update_errors WHERE len(errors) > 0) GROUP BY ALL)
      UNION ALL SELECT project_id, 'summary', '', '', CASE WHEN u.project_id IS NOT NULL AND project_id % 2 = 0 THEN 'Seen again' ELSE coalesce(s, '') END FROM (SELECT DISTINCT project_id, concat('Survey of ', project_id) AS s FROM kg_nodes) FULL JOIN (SELECT DISTINCT project_id FROM v_kg_update) u USING (project_id)""",
)
def _(spark, sf):
    from srcloom.operators import graph_update as gu

    sources = corpus.kg_sources(spark, sf)
    number = F.substring("node_id", 2, 20).cast("long").alias("ord")
    fields = ["project_id", "node_id", "type", "label", "summary", "confidence"]
    nodes = survey.node_errors(corpus.kg_nodes(spark, sf), sources).withColumnRenamed("item_id", "node_id").filter(F.size("errors") == 0)
    nodes = nodes.select(*fields, number)
    links = ["project_id", "edge_id", "type", "from_id", "to_id", "confidence"]
    edges = survey.edge_errors(corpus.kg_edges(spark, sf), nodes, sources).withColumnRenamed("item_id", "edge_id").filter(F.size("errors") == 0)
    edges = edges.select(*links, F.substring("edge_id", 2, 20).cast("long").alias("ord"))
    seen = corpus.table(spark, sf, "customer").selectExpr(*[x.strip() for x in _split_columns(_UPDATE)])
    linked = corpus.table(spark, sf, "part").selectExpr(*[x.strip() for x in _split_columns(_EDGE_UPDATE)])
    bad = sources.filter("end_line < start_line").select("project_id", F.concat(F.lit("Bad source in "), "owner_id").alias("warning"), "ord")
    unclear = seen.filter("type = 'other'").select("project_id", F.concat(F.lit("Unclear role of "), "label").alias("warning"), number)
    projects = corpus.kg_nodes(spark, sf).select("project_id").distinct()
    base = gu.Graph(
        nodes, edges, sources, _inspected(spark, sf).withColumn("ord", F.lit(0).cast("long")), bad,
        projects.withColumn("summary", F.concat(F.lit("Survey of "), F.col("project_id").cast("string"))),
    )
    again = F.when(F.col("project_id") % 2 == 0, "Seen again").otherwise("  ").alias("summary")
    update = gu.Graph(
        seen.select(*fields, number), linked, sources, sources.select("project_id", "file_path", "ord"), unclear,
        seen.select("project_id").distinct().select("project_id", again),
    )
    merged = gu.merge_update(base, update)

    def part(name, table, item, outcome, detail):
        return table.select("project_id", F.lit(name).alias("part"), item.alias("item"), outcome.alias("outcome"), detail.alias("detail"))

    c, none = F.col, F.lit("")
    ends = F.concat("from_id", F.lit(">"), "to_id")
    out = part("node", merged["nodes"], c("node_id"), c("outcome"), c("label"))
    out = out.unionByName(part("edge", merged["edges"], c("edge_id"), c("outcome"), ends))
    out = out.unionByName(part("inspected", merged["inspected"], c("file_path"), none, c("pos").cast("string")))
    out = out.unionByName(part("warning", merged["warnings"], c("warning"), none, c("pos").cast("string")))
    return out.unionByName(part("summary", merged["summaries"], none, none, c("summary")))


_WEIGHT = f"coalesce({q.lit_map('type', dims.NODE_PRIORITY)}, 0) + coalesce({q.lit_map('confidence', dims.CONFIDENCE_PRIORITY)}, 0) + least(5, n_sources) * 4"
views.register(
    "v_compact_nodes",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, node_id) AS rank FROM (
      SELECT project_id, node_id, type, label, left(summary, 260) AS summary, confidence, {_WEIGHT} AS weight FROM v_node_errors)) WHERE rank <= 14""",
)
views.register(
    "v_compact_edges",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY certain DESC, n_sources DESC, edge_id) AS rank FROM (
      SELECT *, {q.lit_map('confidence', dims.CONFIDENCE_PRIORITY)} AS certain FROM v_edge_errors WHERE n_sources > 0
        AND (project_id, from_id) IN (SELECT (project_id, node_id) FROM v_compact_nodes) AND (project_id, to_id) IN (SELECT (project_id, node_id) FROM v_compact_nodes))) WHERE rank <= 12""",
)


def _compact(spark, sf):
    sources = corpus.kg_sources(spark, sf)
    nodes = survey.compact_nodes(corpus.kg_nodes(spark, sf), sources)
    return nodes, survey.compact_edges(corpus.kg_edges(spark, sf), nodes, sources), sources


@query(
    "compact_graph",
    """SELECT project_id, 'node' AS item, node_id AS item_id, rank FROM v_compact_nodes UNION ALL SELECT project_id, 'edge', edge_id, rank FROM v_compact_edges""",
)
def _(spark, sf):
    nodes, edges, _ = _compact(spark, sf)
    n = nodes.select("project_id", F.lit("node").alias("item"), F.col("node_id").alias("item_id"), "rank")
    return n.unionByName(edges.select("project_id", F.lit("edge").alias("item"), F.col("edge_id").alias("item_id"), "rank"))


@query("graph_sources", "SELECT DISTINCT project_id, file_path, start_line, end_line FROM kg_sources")
def _(spark, sf):
    return survey.graph_sources(corpus.kg_sources(spark, sf))


views.register(
    "v_refs",
    """SELECT project_id, owner_id, string_agg(tag, ' ' ORDER BY ord) AS three, string_agg(tag, ' ' ORDER BY ord) FILTER (WHERE rn <= 2) AS two FROM (
      SELECT *, concat(file_path, ':', start_line, '-', end_line) AS tag, row_number() OVER (PARTITION BY project_id, owner_id ORDER BY ord) AS rn FROM kg_sources) WHERE rn <= 3 GROUP BY ALL""",
)


@query(
    "format_graph",
    """SELECT project_id, string_agg(line, chr(10) ORDER BY part, rank) AS text FROM (
      SELECT n.project_id, 1 AS part, rank, concat('- ', node_id, ' | ', type, ': ', label, ' (', coalesce(confidence, ''), ') - ', summary, ' Evidence: ', coalesce(three, ''), '.') AS line
        FROM v_compact_nodes n LEFT JOIN v_refs r ON r.project_id = n.project_id AND r.owner_id = n.node_id
      UNION ALL SELECT e.project_id, 2, rank, concat('- ', type, ': ', from_id, ' -> ', to_id, ' (', coalesce(confidence, ''), ')  Evidence: ', coalesce(two, ''), '.')
        FROM v_compact_edges e LEFT JOIN v_refs r ON r.project_id = e.project_id AND r.owner_id = e.edge_id) GROUP BY project_id""",
)
def _(spark, sf):
    return survey.format_graph(*_compact(spark, sf))


_REQ = q.arr(dims.REQUIRED_NODE_TYPES)


@query(
    "graph_coverage_eval",
    f"""SELECT project_id, CAST(floor(((6 - len(missing)) / 6 * 0.55::DOUBLE + least(1.0::DOUBLE, backed) * 0.35::DOUBLE + CASE WHEN uncertain THEN 1.0::DOUBLE ELSE 0.0 END * 0.1::DOUBLE) * 100 + 0.5) AS BIGINT) AS score,
      array_to_string(present, '|') AS present, array_to_string(missing, '|') AS missing, round(backed, 6) AS backed, uncertain, array_to_string({q.compact([
        "CASE WHEN NOT list_contains(present, 'workflow') THEN 'No workflow nodes were produced.' END",
        "CASE WHEN NOT list_contains(present, 'boundary') THEN 'No input/output or external boundary nodes were produced.' END",
        "CASE WHEN NOT list_contains(present, 'state') THEN 'No state or data nodes were produced.' END",
        "CASE WHEN backed < 0.8 THEN 'Too many graph nodes lack source evidence.' END",
        "CASE WHEN NOT uncertain THEN 'No uncertainty or risk was recorded.' END"])}, '|') AS findings FROM (
      SELECT *, list_filter({_REQ}, lambda x: NOT list_contains(present, x)) AS missing FROM (
        SELECT project_id, list_sort(list(DISTINCT type)) AS present, avg(CASE WHEN n_sources > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS backed, bool_or(type = 'risk') AS uncertain FROM v_node_errors GROUP BY project_id))""",
)
def _(spark, sf):
    out = survey.coverage(corpus.kg_nodes(spark, sf), corpus.kg_sources(spark, sf))
    return out.withColumns({c: F.array_join(c, "|") for c in ("present", "missing", "findings")})


views.register("v_small_inspected", "SELECT project_id, file_path FROM files JOIN labels USING (doc_id) WHERE quality = 1")


@query(
    "graph_source_units",
    f"""SELECT project_id, concat('graph-source:', file_path, ':', start_line, '-', end_line) AS id, file_path, {q.basename('file_path')} AS name,
      {q.lit_map(_X, dims.SOURCE_REF_LANGUAGES, "coalesce(nullif(regexp_replace(" + _X + ", '^[.]', ''), ''), 'text')")} AS language, start_line, end_line,
      md5(coalesce(array_to_string(list_slice(regexp_split_to_array(content, '\\r?\\n'), start_line, end_line), chr(10)), '')) AS code
      FROM (SELECT DISTINCT project_id, file_path, start_line, end_line FROM kg_sources WHERE end_line >= start_line) JOIN v_small_inspected USING (project_id, file_path) JOIN files USING (project_id, file_path)""",
)
def _(spark, sf):
    good = corpus.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    small = corpus.files(spark, sf)
    inspected = small.join(good, "doc_id", "left_semi")
    out = survey.graph_source_units(corpus.kg_sources(spark, sf), inspected, small)
    return out.withColumn("code", F.md5("code"))


@query(
    "node_citation",
    """SELECT project_id, owner_id AS node_id, arg_min(CASE WHEN inside THEN concat('[', file_path, ':', start_line, '-', end_line, ']') ELSE concat('[', file_path, ':', us, '-', ue, ']') END,
        (ord, CASE WHEN inside THEN 0 ELSE 1 END, us)) AS citation FROM (
      SELECT s.*, u.start_line AS us, u.end_line AS ue, s.start_line >= u.start_line AND s.end_line <= u.end_line AS inside FROM kg_sources s JOIN units u
        ON u.project_id = s.project_id AND u.file_path = s.file_path AND ((u.start_line <= s.end_line AND u.end_line >= s.start_line) OR (s.start_line >= u.start_line AND s.end_line <= u.end_line))) GROUP BY ALL""",
)
def _(spark, sf):
    ctx = corpus.units(spark, sf).select("project_id", "file_path", "start_line", "end_line", F.col("start_line").alias("ord"))
    return survey.node_citations(corpus.kg_sources(spark, sf), ctx)
