"""Merging a survey's observations into the graphs of many projects.

An update is taken as far as it is sound. Nodes are judged on their own; an edge also needs both ends among the nodes
that are there afterwards. Of several sound versions of one id the last counts. What is refused leaves a warning per
error and per item, so a project whose update is sound as a whole gets none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.operators import survey
from srcloom.staging import stage


@dataclass
class Graph:
    """Tables of the graphs of many projects.

    ``nodes``: (project_id, node_id, type, label, summary, confidence, ord); ``edges``: (project_id, edge_id, type, from_id, to_id, confidence,
    ord); ``sources``: (project_id, owner_id, ord, file_path, start_line, end_line); ``inspected``: (project_id, file_path, ord);
    ``warnings``: (project_id, warning, ord); ``summaries``: (project_id, summary).
    """

    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame
    inspected: DataFrame
    warnings: DataFrame
    summaries: DataFrame


def _settle(base: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Rows of a table after the update, and the refused ones, told apart by ``outcome``."""
    columns = base.columns
    sound = judged.filter(F.size("errors") == 0)
    last = Window.partitionBy("project_id", key).orderBy(F.desc("ord"))
    taken = sound.withColumn("n", F.row_number().over(last)).filter("n = 1").select(columns)
    old = base.select("project_id", key).withColumn("known", F.lit(True))
    taken = taken.join(old, ["project_id", key], "left").withColumn("outcome", F.when(F.col("known"), "updated").otherwise("added"))
    kept = base.join(sound.select("project_id", key), ["project_id", key], "left_anti").withColumn("outcome", F.lit("kept"))
    refused = judged.filter(F.size("errors") > 0).withColumn("outcome", F.lit("rejected"))
    none = F.array().cast("array<string>")
    parts = [kept.withColumn("errors", none), taken.withColumn("errors", none), refused]
    return parts[0].select(*columns, "outcome", "errors").unionByName(parts[1].select(*columns, "outcome", "errors")).unionByName(
        parts[2].select(*columns, "outcome", "errors")
    )


def settled_nodes(base: Graph, update: Graph) -> DataFrame:
    judged = survey.node_errors(update.nodes, update.sources, unique=False).withColumnRenamed("item_id", "node_id")
    return _settle(base.nodes, judged, "node_id")


def settled_edges(base: Graph, update: Graph, nodes: DataFrame) -> DataFrame:
    """``nodes``: the settled nodes; the ends of an edge must be among those that stand."""
    standing = nodes.filter("outcome <> 'rejected'").select("project_id", "node_id").distinct()
    judged = survey.edge_errors(update.edges, standing, update.sources, unique=False).withColumnRenamed("item_id", "edge_id")
    return _settle(base.edges, judged, "edge_id")


def refusals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, warning, tier, ord, id): a warning per error of an update, then one per refused item."""
    items = [
        rows.filter("outcome = 'rejected'").select("project_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), "ord", "errors")
        for kind, key, rows in (("node", "node_id", nodes), ("edge", "edge_id", edges))
    ]
    refused = items[0].unionByName(items[1])
    whole = refused.select(
        "project_id", F.explode("errors").alias("error"), F.when(F.col("kind") == "node", 0).otherwise(1).alias("tier"), "ord", "id"
    ).withColumn("warning", F.concat(F.lit("Rejected full graph update: "), "error"))
    each = refused.select(
        "project_id",
        F.concat(F.lit("Rejected graph "), "kind", F.lit(" "), "id", F.lit(": "), F.array_join("errors", "; ")).alias("warning"),
        F.when(F.col("kind") == "node", 2).otherwise(3).alias("tier"),
        "ord",
        "id",
    )
    columns = ["project_id", "warning", "tier", "ord", "id"]
    return whole.select(columns).unionByName(each.select(columns))


def _in_order(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values of a project in the order of their first (tier, ord, id), numbered by ``pos``."""
    first = rows.groupBy("project_id", value).agg(F.min(F.struct("tier", "ord", "id")).alias("first"))
    order = Window.partitionBy("project_id").orderBy("first", value)
    return first.withColumn("pos", F.row_number().over(order)).drop("first")


def merge_update(base: Graph, update: Graph) -> dict[str, DataFrame]:
    """The merged graph: nodes and edges with ``outcome`` and ``errors``, sources, inspected files, warnings and summaries.

    ``base`` is taken as sound. Sources follow the version of an item that stands. The settled nodes and edges are read by
    several parts, so they are staged.
    """
    nodes = stage(settled_nodes(base, update), "settled-nodes")
    edges = stage(settled_edges(base, update, nodes), "settled-edges")
    owner = nodes.select("project_id", F.col("node_id").alias("owner_id"), "outcome").unionByName(
        edges.select("project_id", F.col("edge_id").alias("owner_id"), "outcome")
    )
    of = lambda *outcomes: owner.filter(F.col("outcome").isin(*outcomes)).select("project_id", "owner_id").distinct()
    keys = ["project_id", "owner_id"]
    sources = base.sources.join(of("kept"), keys, "left_semi").unionByName(update.sources.join(of("updated", "added"), keys, "left_semi"))

    def ranked(first, second, value):
        parts = [t.select("project_id", value, F.lit(i).alias("tier"), "ord", F.col(value).alias("id")) for i, t in ((-2, first), (-1, second))]
        return parts[0].unionByName(parts[1])

    inspected = _in_order(ranked(base.inspected, update.inspected, "file_path"), "file_path")
    warnings = _in_order(ranked(base.warnings, update.warnings, "warning").unionByName(refusals(nodes, edges)), "warning")
    newer = update.summaries.select("project_id", F.nullif(F.trim("summary"), F.lit("")).alias("newer"))
    summaries = base.summaries.join(newer, "project_id", "full_outer").select(
        "project_id", F.coalesce("newer", "summary", F.lit("")).alias("summary")
    )
    return {"nodes": nodes, "edges": edges, "sources": sources, "inspected": inspected, "warnings": warnings, "summaries": summaries}
