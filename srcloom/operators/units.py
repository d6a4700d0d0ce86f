"""From file contents to code units. Row-local apart from the module anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths

DECL_TYPE = "struct<line:int,kind:string,name:string,indent:int,exported:boolean>"


def unit_id(*parts: str) -> Column:
    """Stable id: reruns of a job give the same unit the same id."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def _line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def text_modules(files: DataFrame) -> DataFrame:
    """One module per .json/.prisma file."""
    ext = paths.extname(F.col("file_path"))
    return files.filter(ext.isin(dims.TEXT_EXTENSIONS)).select(
        "project_id",
        "file_path",
        F.substring_index(ext, ".", -1).alias("language"),
        F.lit("module").alias("kind"),
        paths.basename(F.col("file_path")).alias("name"),
        F.col("content").alias("code"),
        F.lit(1).alias("start_line"),
        _line_count(F.col("content")).alias("end_line"),
    )


def markdown_modules(files: DataFrame) -> DataFrame:
    """One module per non-blank document, named after its first heading."""
    ext = paths.extname(F.col("file_path"))
    heading = F.substring(rx.trim(rx.extract(F.col("content"), r"^#\s+(.+)$", 1, "m")), 1, 120)
    has_heading = rx.test(F.col("content"), r"^#\s+(.+)$", "m")
    return files.filter(ext.isin(dims.DOC_EXTENSIONS) & (rx.trim(F.col("content")) != "")).select(
        "project_id",
        "file_path",
        F.lit("markdown").alias("language"),
        F.lit("module").alias("kind"),
        F.when(has_heading, heading).otherwise(paths.stem(F.col("file_path"))).alias("name"),
        F.col("content").alias("code"),
        F.lit(1).alias("start_line"),
        _line_count(F.col("content")).alias("end_line"),
    )


def _group(path: Column) -> Column:
    return F.try_element_at(paths.lit_map(dims.LANGUAGE_GROUPS), paths.extname(path))


def _pick_by_group(group: Column, per_group: dict[str, Column], default: Column) -> Column:
    return reduce(lambda acc, kv: F.when(group == kv[0], kv[1]).otherwise(acc), per_group.items(), default)


def _declaration(group: Column, line: Column, index: Column) -> Column:
    """Declaration found on a line, or null."""

    def for_group(table):
        out = F.lit(None).cast(DECL_TYPE)
        for kind, pattern in reversed(table):
            name = rx.extract(line, pattern, 2)
            found = F.struct(
                (index + 1).alias("line"),
                F.lit(kind).alias("kind"),
                name.alias("name"),
                F.length(rx.extract(line, pattern, 1)).alias("indent"),
                rx.test(line, dims.EXPORT_LINE).alias("exported"),
            ).cast(DECL_TYPE)
            out = F.when((name != "") & ~name.isin(dims.CONTROL_WORDS), found).otherwise(out)
        return out

    # Cheap test first: most lines hold neither a declaration word nor an opening brace.
    per_group = {g: for_group(t) for g, t in dims.DECLARATIONS.items()}
    found = _pick_by_group(group, per_group, F.lit(None).cast(DECL_TYPE))
    return F.when(F.rlike(line, F.lit(dims.DECLARATION_HINT)), found)


def declarations(files: DataFrame) -> DataFrame:
    """Code units found by line rules in the supported source languages.

    A unit runs to the line before the next declaration with the same or a smaller
    indent. This approximates a syntax tree; only the rules above are claimed.
    """
    p = F.col("file_path")
    body = files.withColumn("grp", _group(p)).filter("grp is not null").withColumn(
        "ls", F.split("content", "\n", -1)
    )
    found = body.withColumn(
        "decls",
        F.array_compact(F.transform("ls", lambda line, i: _declaration(F.col("grp"), line, i))),
    )

    def parent_of(d):
        classes = F.filter(
            "decls", lambda o: (o["kind"] == "class") & (o["line"] < d["line"]) & (o["indent"] < d["indent"])
        )
        return F.try_element_at(classes, F.lit(-1))["name"]

    def close(d):
        later = F.filter("decls", lambda o: (o["line"] > d["line"]) & (o["indent"] <= d["indent"]))
        end = F.coalesce(F.get(later, 0)["line"] - 1, F.size("ls"))
        return F.struct(d.alias("d"), end.alias("end_line"), parent_of(d).alias("parent"))

    rows = found.select(
        "project_id", "file_path", "ls", F.explode(F.transform("decls", close)).alias("u")
    ).select("project_id", "file_path", "ls", "u.d.*", "u.end_line", "u.parent")
    kind = F.when((F.col("kind") == "function") & F.col("parent").isNotNull(), "method").otherwise(F.col("kind"))
    return rows.select(
        "project_id",
        "file_path",
        F.try_element_at(paths.lit_map(dims.GROUP_LANGUAGES), paths.extname(p)).alias("language"),
        kind.alias("kind"),
        "name",
        F.array_join(F.slice("ls", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n").alias("code"),
        F.col("line").alias("start_line"),
        "end_line",
        F.when(kind == "method", F.col("parent")).alias("parent_name"),
        "exported",
    )


def import_statements(path: Column, content: Column) -> Column:
    per_group = {g: F.array_distinct(rx.extract_all(content, p, 0, "m")) for g, p in dims.IMPORT_LINES.items()}
    return _pick_by_group(_group(path), per_group, F.array().cast("array<string>"))


def called_functions(code: Column) -> Column:
    """Names followed by a parenthesis; a member call also yields its last part."""
    names = rx.extract_all(code, dims.CALL)
    both = F.flatten(F.transform(names, lambda n: F.array(n, F.substring_index(n, ".", -1))))
    return F.array_distinct(F.filter(both, lambda n: (n != "") & ~n.isin(dims.CONTROL_WORDS)))


def module_anchors(units: DataFrame, files: DataFrame) -> DataFrame:
    """A whole-file module for every file whose units do not include one at line 1.

    Its text is that of the file where ``files`` brings it; otherwise it is put together from the units of the file, from
    the first line on. List columns that the units lack are left out.
    """
    first = F.struct("start_line", "name")
    lists = [c for c in ("exported_names", "imports", "called_functions") if c in units.columns]
    texts = ["docstring"] if "docstring" in units.columns else []
    anchors = (
        units.groupBy("project_id", "file_path")
        .agg(
            F.bool_or((F.col("kind") == "module") & (F.col("start_line") == 1)).alias("anchored"),
            F.min_by("language", first).alias("language"),
            F.max("end_line").alias("last_line"),
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists],
            *[F.min_by(c, first).alias(c) for c in texts],
            F.bool_and("is_vendored").alias("is_vendored"),
        )
        .filter("not anchored")
        .drop("anchored")
    )
    keys = ["project_id", "file_path"]
    whole = anchors.join(files.filter("content is not null").select(*keys, "content"), keys, "left")
    if "code" in units.columns:
        # Only files without a text of their own are put together from their units.
        bare = whole.filter("content is null").select(*keys)
        pieces = F.array_sort(F.collect_list(F.struct("start_line", "name", "code")))
        built = units.select(*keys, "start_line", "name", "code").join(bare, keys, "left_semi").groupBy(*keys).agg(pieces.alias("pieces"))
        whole = whole.join(built.select(*keys, F.array_join(F.col("pieces.code"), "\n\n").alias("joined")), keys, "left")
    else:
        whole = whole.withColumn("joined", F.lit(None).cast("string"))
    return whole.select(
        "project_id",
        "file_path",
        "language",
        F.lit("module").alias("kind"),
        paths.stem(F.col("file_path")).alias("name"),
        F.lit(1).alias("start_line"),
        F.coalesce(_line_count(F.col("content")), F.col("last_line")).alias("end_line"),
        *lists,
        *texts,
        "is_vendored",
        F.coalesce("content", "joined").alias("code"),
    )


def index_stats(units: DataFrame, anchors: DataFrame) -> DataFrame:
    """Unit counts per kind, vendored units and files, and anchors added."""
    per_project = units.groupBy("project_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("function", "class", "method", "module")],
        F.count_if("is_vendored").alias("vendored_units"),
        F.count_distinct(F.when(F.col("is_vendored"), F.col("file_path"))).alias("vendored_files"),
    )
    added = anchors.groupBy("project_id").agg(F.count("*").alias("anchors"))
    return per_project.join(added, "project_id", "left").fillna(0, ["anchors"])
