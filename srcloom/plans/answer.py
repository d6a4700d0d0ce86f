"""From questions to packed contexts: the batch form of answering a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom import dims
from srcloom.functions import questions
from srcloom.operators import fuse, graph, pack, retrieve
from srcloom.staging import stage

CHANNEL_K = {
    "exact": dims.FUSED_TOP_K,
    "overview": dims.FUSED_TOP_K,
    "grep": 2 * dims.FUSED_TOP_K,
    "lexical": dims.FUSED_TOP_K,
}


def plans(queries: DataFrame) -> DataFrame:
    """Questions with features, plan, traversal direction and context budget.

    One row per question, read by nearly every later step, so it is staged.
    """
    df = questions.with_plan(fuse.with_features(queries)).withColumns(
        {
            "traversal": questions.traversal(F.col("query")),
            "max_tokens": pack.context_budget(F.col("ratio")),
            "max_per_file": F.when(F.col("mode") == "summary_graph", 2).otherwise(3),
        }
    )
    return stage(df, "plans")


def judged(units: DataFrame) -> DataFrame:
    """Units with all that the rules find in their text, which retrieval, reranking and packing read."""
    return retrieve.with_overview(retrieve.with_support(fuse.with_marks(units)))


def reranked(planned: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """Reranked hits. At most ten rows per question, read by several later steps."""
    hits = retrieve.all_channels(queries, units, CHANNEL_K)
    return stage(fuse.rerank(planned, fuse.retrieve_by_plan(planned, hits), units), "reranked")


def reached_files(planned: DataFrame, hits: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Files reached from the retrieved ones, following the direction of each question."""
    seeds = hits.join(planned.select("query_id", "traversal"), "query_id").select(
        "query_id", "project_id", F.col("file_path").alias("node"), "traversal"
    )
    links = edges.select("project_id", F.col("source_file").alias("source"), F.col("target_file").alias("target"))

    def walk(skipped, mode):
        mine = seeds.filter(F.col("traversal") != skipped).drop("traversal").distinct()
        return graph.traverse(mine, links, depth, mode, ["project_id"])

    both = walk("downstream", "upstream").unionByName(walk("upstream", "downstream"))
    return both.groupBy("query_id", "project_id", "node").agg(F.min("depth").alias("depth"))


def candidates(planned: DataFrame, hits: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered context candidates: graph neighbours or class/call neighbours, as planned."""
    flag = planned.select("query_id", "use_graph")
    with_graph = hits.join(flag.filter("use_graph"), "query_id", "left_semi")
    without = hits.join(flag.filter("use_graph"), "query_id", "left_anti")
    heads = units.select("project_id", "id", "file_path", "start_line")
    nodes = reached_files(planned, with_graph, edges)
    graphed = graph.expand_by_graph(with_graph, nodes, heads).select("query_id", "project_id", "unit_id", "ord")
    return graphed.unionByName(pack.expand_context(without, units))


def packed(queries: DataFrame, units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(planned questions, packed units) ready for prompting."""
    planned = plans(queries)
    units = stage(judged(units), "judged")
    hits = reranked(planned, queries, units)
    chosen = candidates(planned, hits, units, edges)
    return planned, pack.pack(pack.pack_scores(planned, chosen, hits, units))
