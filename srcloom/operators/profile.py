"""Project, file and directory profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions import paths

KINDS = ["function", "class", "method", "module"]


def _dir():
    return paths.dirname(F.col("file_path")).alias("directory")


def project_stats(units: DataFrame) -> DataFrame:
    """Unit counts by kind, by language and in total in one pass."""
    sets = [["project_id", "kind"], ["project_id", "language"], ["project_id"]]
    grouped = units.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("project_id"), F.col("kind"), F.col("language")
    )
    return grouped.agg(F.count("*").alias("units"), F.count_distinct("file_path").alias("files")).select(
        "project_id",
        F.when(F.col("kind").isNotNull(), "kind").when(F.col("language").isNotNull(), "language").otherwise("total").alias("facet"),
        F.coalesce("kind", "language", F.lit("")).alias("value"),
        "units",
        "files",
    )


def file_nodes(units: DataFrame) -> DataFrame:
    return units.groupBy("project_id", "file_path").agg(
        F.count("*").alias("unit_count"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def directory_nodes(units: DataFrame) -> DataFrame:
    return units.groupBy("project_id", _dir()).agg(
        F.count_distinct("file_path").alias("file_count"), F.count("*").alias("unit_count")
    )


def directory_profile(units: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """Counts, sample docstrings and link counts of a directory.

    Names and neighbours can be many, so they stay rows: see
    :func:`directory_unit_names` and ``graph.directory_edges``.
    """
    keys = ["project_id", "directory"]
    slim = units.select("project_id", _dir(), "file_path", "kind", "start_line", "id", "docstring")
    counts = slim.groupBy(*keys).agg(
        F.count_distinct("file_path").alias("file_count"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
    )
    w = Window.partitionBy(*keys).orderBy("file_path", "start_line", "id")
    docs = (
        slim.filter(F.col("docstring") != "")
        .withColumn("rn", F.row_number().over(w))
        .filter("rn <= 3")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "docstring"))).alias("d"))
        .select(*keys, F.col("d.docstring").alias("docstrings"))
    )
    out_links = dir_edges.groupBy("project_id", F.col("from_dir").alias("directory")).agg(F.count("*").alias("imports_from"))
    in_links = dir_edges.groupBy("project_id", F.col("to_dir").alias("directory")).agg(F.count("*").alias("imported_by"))
    return (
        counts.join(docs, keys, "left")
        .join(out_links, keys, "left")
        .join(in_links, keys, "left")
        .fillna(0, ["imports_from", "imported_by"])
        .withColumn("docstrings", F.coalesce("docstrings", F.array().cast("array<string>")))
    )


def directory_unit_names(units: DataFrame) -> DataFrame:
    """Function and class names of a directory, one row each."""
    return units.filter(F.col("kind").isin("function", "class")).select(
        "project_id", _dir(), "file_path", "start_line", "name"
    )


def codebase_structure(units: DataFrame, dir_edges: DataFrame, entries: DataFrame) -> DataFrame:
    totals = units.select("project_id", "file_path", _dir()).groupBy("project_id").agg(
        F.count("*").alias("units"),
        F.count_distinct("file_path").alias("files"),
        F.count_distinct("directory").alias("directories"),
    )
    edges = dir_edges.groupBy("project_id").agg(F.count("*").alias("directory_edges"))
    starts = entries.groupBy("project_id").agg(F.count("*").alias("entry_points"))
    return (
        totals.join(edges, "project_id", "left")
        .join(starts, "project_id", "left")
        .fillna(0, ["directory_edges", "entry_points"])
    )


def summarizable(profiles: DataFrame) -> DataFrame:
    """Directories worth a summary: enough units, not deep library or test folders."""
    parts = F.split("directory", "/", -1)
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    deep = (F.size(parts) >= 4) & F.arrays_overlap(parts, paths.strings(["lib", "test"]))
    return profiles.filter((total > 2) & ~deep)
