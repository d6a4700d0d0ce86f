"""Stored units, projects, sessions and graphs as plain parquet tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom import staging

_LISTS = ["imports", "exportedNames", "calledFunctions"]
_NUMBERS = ["startLine", "endLine"]
_REQUIRED = ["id", "filePath"]
#: Unit fields as files name them, and as tables do.
UNIT_FIELDS = {
    "id": "id", "filePath": "file_path", "language": "language", "kind": "kind", "name": "name", "code": "code", "startLine": "start_line",
    "endLine": "end_line", "parentName": "parent_name", "imports": "imports", "docstring": "docstring", "exportedNames": "exported_names",
    "calledFunctions": "called_functions", "isVendored": "is_vendored",
}


def load_units(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """Code units from JSON: a unit per line, or with ``array_files`` one array per file.

    Every field is read as text and then fitted to its type on its own, so one bad field costs that field and not
    the unit. ``problems`` names each: a line that is no JSON object, a missing id or path, a number or a list
    that is none. List fields may also be JSON text; a list with anything but strings counts as empty.
    """
    raw = ", ".join(f"{name} string" for name in UNIT_FIELDS) + ", _corrupt string"
    rows = (
        spark.read.schema(raw).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", array_files).json(path)
    )

    def fitted(name):
        c = F.col(name)
        if name in _LISTS:
            return strict_string_array(c)
        if name in _NUMBERS:
            return F.try_to_number(c, F.lit("999999999")).cast("int")
        if name == "isVendored":
            return F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))
        return c

    lists = [F.when(F.col(n).isNotNull() & ~_is_string_list(F.col(n)), f"{n} is not a list of strings") for n in _LISTS]
    numbers = [F.when(F.col(n).isNotNull() & fitted(n).isNull(), f"{n} is not a number") for n in _NUMBERS]
    missing = [F.when(F.coalesce(F.col(n), F.lit("")) == "", f"{n} is missing") for n in _REQUIRED]
    found = F.array_compact(F.array(*missing, *numbers, *lists))
    problems = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("not a JSON object"))).otherwise(found)
    whole = F.col("_corrupt").isNull()
    empty = {**{n: _none() for n in _LISTS}, "isVendored": F.lit(False)}
    fields = [F.when(whole, fitted(n)).otherwise(empty.get(n, F.lit(None))).alias(to) for n, to in UNIT_FIELDS.items()]
    return rows.select(*fields, problems.alias("problems"))


def _items(json: Column) -> Column:
    """Array items as variants; null when the text is not a JSON array."""
    return F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")


def _is_string(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item) == "STRING", F.lit(False))


def _to_string(item: Column) -> Column:
    return F.try_variant_get(item, "$", "string")


def _is_string_list(json: Column) -> Column:
    return F.coalesce(F.forall(_items(json), _is_string), F.lit(False))


def _none() -> Column:
    return F.array().cast("array<string>")


def strict_string_array(json: Column) -> Column:
    """All items must be strings, otherwise the list counts as empty."""
    items = _items(json)
    return F.coalesce(F.when(F.forall(items, _is_string), F.transform(items, _to_string)), _none())


def lenient_string_array(json: Column) -> Column:
    """Items that are not strings are dropped one by one."""
    return F.coalesce(F.transform(F.filter(_items(json), _is_string), _to_string), _none())


def source_refs(json: Column) -> Column:
    """Array of (file_path, name, kind, lines); items that lack one of these as a text are dropped."""
    fields = {"filePath": "file_path", "name": "name", "kind": "kind", "lines": "lines"}
    part = lambda item, name: F.try_variant_get(item, f"$.{name}", "variant")
    whole = lambda item: reduce(lambda a, b: a & b, [_is_string(part(item, n)) for n in fields])
    ref = lambda item: F.struct(*[_to_string(part(item, n)).alias(to) for n, to in fields.items()])
    none = F.array().cast("array<struct<file_path:string,name:string,kind:string,lines:string>>")
    return F.coalesce(F.transform(F.filter(_items(json), whole), ref), none)


def project_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("project_id").agg(
        F.count("*").alias("unit_count"), F.count_distinct("file_path").alias("file_count")
    )


#: Rows that one file of a project's partition holds, about, and projects that a replacement gives a folder each at most.
ROWS_PER_FILE, MOST_FOLDERS = 200_000, 1_000


def _overwrite_projects(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the projects in ``df`` and leave the others alone.

    A project is spread over as many files as its rows need, so a huge one is not one task.
    """
    sizes = df.groupBy("project_id").agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("slices"))
    keyed = df.join(sizes, "project_id").withColumn("slice", F.pmod(F.xxhash64(*df.columns), "slices"))
    (
        keyed.repartition("project_id", "slice")
        .drop("slices", "slice")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_id")
        .parquet(path)
    )


PROJECT_SCHEMA = "project_id long, repo_path string, unit_count long, file_count long"
#: Where the units of a project are.
_PLACE = ", together boolean"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or an empty one before the first write."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table with the ``run`` that wrote each row."""
    return _stored(spark, path, spark.createDataFrame([], schema).withColumn("run", F.lit(0).cast("long")).schema)


def _current(projects: DataFrame) -> DataFrame:
    """The last written row of each project."""
    last = F.max_by(F.struct(*projects.columns), "run").alias("p")
    return projects.groupBy("project_id").agg(last).select("p.*")


def replace_index(folder: str, projects: DataFrame, units: DataFrame, edges: DataFrame) -> None:
    """Replace the whole index of the projects named by ``projects`` (project_id, repo_path).

    Units and edges of other projects stay untouched. A project of another id with the same ``repo_path`` goes away. Edges,
    project rows and the units of many projects go to one folder per replacement, in files that follow the rows; the units
    of up to ``MOST_FOLDERS`` projects are replaced in a folder of each. The project rows are written last and decide what
    readers see: a run that fails before leaves the counts of the old index, and a project without units leaves none of its
    old ones.
    """
    spark = projects.sparkSession
    counts = units.groupBy("project_id").agg(F.count("*").alias("unit_count"), F.count_distinct("file_path").alias("file_count"))
    rows = projects.join(counts, "project_id", "left").fillna(0, ["unit_count", "file_count"])
    rows = staging.stage(rows.select("project_id", "repo_path", "unit_count", "file_count"), "projects")
    before = staging.stage(_runs(spark, f"{folder}/projects", PROJECT_SCHEMA + _PLACE), "projects")
    # A number of its own, even if an earlier replacement failed before it wrote its project rows.
    run = max(time.time_ns(), (before.agg(F.max("run")).first()[0] or 0) + 1)
    moved = _current(before).join(rows.select("repo_path"), "repo_path", "left_semi").join(rows.select("project_id"), "project_id", "left_anti")
    gone = moved.select("project_id", F.lit(None).cast("string").alias("repo_path"), *[F.lit(0).cast("long").alias(c) for c in ("unit_count", "file_count")])
    named = rows.select("project_id")
    together = rows.count() > MOST_FOLDERS
    units = units.join(named, "project_id", "left_semi")
    if together:
        units.write.parquet(f"{folder}/units_of_many/run={run}")
    else:
        _overwrite_projects(units, f"{folder}/units")
    edges.join(named, "project_id", "left_semi").write.parquet(f"{folder}/edges/run={run}")
    rows.unionByName(gone).withColumn("together", F.lit(together)).write.parquet(f"{folder}/projects/run={run}")


def read_index(spark: SparkSession, folder: str, unit_schema, edge_schema) -> dict[str, DataFrame]:
    """Projects, units and edges of a stored index, without what replaced or emptied projects left behind."""
    projects = _current(_runs(spark, f"{folder}/projects", PROJECT_SCHEMA + _PLACE)).filter("repo_path is not null")
    full = projects.filter("unit_count > 0").select("project_id", "run", "together")
    own = _stored(spark, f"{folder}/units", unit_schema).join(full.filter("not together"), "project_id", "left_semi")
    many = _runs(spark, f"{folder}/units_of_many", unit_schema).join(full.filter("together"), ["project_id", "run"], "left_semi")
    edges = _runs(spark, f"{folder}/edges", edge_schema).join(full, ["project_id", "run"], "left_semi").drop("run")
    return {"projects": projects.drop("run", "together"), "units": own.unionByName(many.drop("run")), "edges": edges}


def delete_projects(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that survive when projects are deleted; messages go with their session."""
    kept = {}
    for name, df in tables.items():
        if "project_id" in df.columns:
            kept[name] = df.join(gone, "project_id", "left_anti")
        else:
            doomed = tables["sessions"].join(gone, "project_id", "left_semi").select("session_id")
            kept[name] = df.join(doomed, "session_id", "left_anti")
    return kept


def upsert_latest(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per project: the latest of the stored and the new rows."""
    both = stored.unionByName(updates)
    latest = F.max_by(F.struct(*both.columns), F.struct("generated_at", "version")).alias("row")
    return both.groupBy("project_id").agg(latest).select("row.*")


def latest_first(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
