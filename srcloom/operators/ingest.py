"""From a table of files to the files worth indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx, staging
from srcloom.functions import paths


def _no_excluded_dir(p: Column, first: int | None = None) -> Column:
    dirs = F.split(p, "/", -1)
    upto = F.size(dirs) - 1 if first is None else F.least(F.size(dirs) - 1, F.lit(first))
    return ~F.arrays_overlap(F.slice(dirs, F.lit(1), upto), paths.strings(dims.EXCLUDED_DIRS))


def is_indexable(p: Column) -> Column:
    base = paths.basename(p)
    return (
        _no_excluded_dir(p)
        & F.lower(paths.extname(p)).isin(dims.INDEX_EXTENSIONS)
        & ~rx.test(base, dims.LOCK_OR_SNAPSHOT, "i")
        & ~rx.test(base, dims.INDEX_LOCKFILES, "i")
        & ~paths.is_sensitive(p)
    )


def is_surveyable(p: Column) -> Column:
    base = paths.basename(p)
    return (
        _no_excluded_dir(p)
        & F.lower(paths.extname(p)).isin(dims.SURVEY_EXTENSIONS)
        & ~rx.test(base, dims.LOCK_OR_SNAPSHOT, "i")
        & ~rx.test(base, dims.SURVEY_LOCKFILES, "i")
        & ~rx.test(base, dims.SURVEY_BINARIES, "i")
        & ~paths.is_sensitive(p)
    )


def scan(files: DataFrame) -> DataFrame:
    """Keep the files that may be indexed, however deep; ``too_deep`` marks those beyond the depth of a scan."""
    p = F.col("file_path")
    return files.filter(is_indexable(p)).withColumn("too_deep", paths.depth(p) > dims.MAX_DEPTH)


NO_LIMIT = 2**62


def cap_files(files: DataFrame, max_files: int = NO_LIMIT) -> DataFrame:
    """Every file with its rank in path order, the running size, and whether it lies beyond ``max_files``.

    Pass only the columns that are needed later.
    """
    w = Window.partitionBy("project_id").orderBy("file_path")
    return files.select(
        "*",
        F.row_number().over(w).alias("rank"),
        F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running_bytes"),
    ).withColumn("over_file_limit", F.col("rank") > max_files)


def limit_flags(files: DataFrame, max_files: int = NO_LIMIT) -> DataFrame:
    """Per project: was the file limit or the depth limit reached?"""
    p = F.col("file_path")
    too_deep = (paths.depth(p) > dims.MAX_DEPTH) & _no_excluded_dir(p, dims.MAX_DEPTH + 1)
    return files.groupBy("project_id").agg(
        (F.count_if(is_indexable(p)) > max_files).alias("hit_max_files"),
        F.coalesce(F.bool_or(too_deep), F.lit(False)).alias("hit_max_depth"),
    )


def apply_byte_budget(
    capped: DataFrame, max_file_bytes: int = NO_LIMIT, max_total_bytes: int = NO_LIMIT
) -> DataFrame:
    """Mark files that lie beyond the file limit, are too large or no longer fit the byte budget.

    A file that overflows is skipped, a later and smaller one may still fit, so the total is carried in path order. Everything
    before the first overflow follows from a running sum; behind it the rounds of :func:`_walk_left` decide. No project's
    files are gathered in one row.
    """
    flags = capped.select("project_id", "file_path", "bytes", "rank", "over_file_limit")
    open_ = flags.filter("not over_file_limit").withColumn("oversized", F.col("bytes") > max_file_bytes)
    sized = F.when(F.col("oversized"), 0).otherwise(F.col("bytes"))
    w = Window.partitionBy("project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = open_.withColumn("running", F.sum(sized).over(w))
    reason = F.when(F.col("oversized"), "oversized").when(F.col("running") > max_total_bytes, "byte_budget")
    first = running.withColumn("skip_reason", reason).select("project_id", "file_path", "bytes", "rank", "running", "oversized", "skip_reason")
    if max_total_bytes < NO_LIMIT:
        late = F.col("skip_reason") == "byte_budget"
        total = F.coalesce(F.max(F.when((F.col("running") <= max_total_bytes), F.col("running"))), F.lit(0))
        spent = first.groupBy("project_id").agg(total.cast("long").alias("total"))
        fits = _walk_left(first.filter(late).select("project_id", "rank", "bytes"), spent, max_total_bytes)
        keyed = first.join(fits.withColumn("fits", F.lit(True)), ["project_id", "rank"], "left")
        first = keyed.withColumn("skip_reason", F.when(F.col("fits").isNull(), F.col("skip_reason")))
    within = first.select("project_id", "file_path", "bytes", "skip_reason")
    beyond = capped.filter("over_file_limit").select("project_id", "file_path", "bytes", F.lit("file_limit").alias("skip_reason"))
    return within.unionByName(beyond)


def _walk_left(left: DataFrame, spent: DataFrame, most: int) -> DataFrame:
    """(project_id, rank) of the files that still fit after the first overflow.

    A round looks at the files no larger than the room that is left. Small files, at most half the room each, all fit until
    they fill half of it; a large one fits when the small ones before it leave it the room. The first large file that fits, or
    the small one that passes the half, ends the round with less than half the room left, so the rounds
    are no more than the binary digits of the budget, whatever the number of files.
    """
    taken = left.select("project_id", "rank").limit(0)
    rest = left
    while True:
        room = spent.select("project_id", (F.lit(most) - F.col("total")).alias("room"))
        small = F.col("bytes") * 2 <= F.col("room")
        w = Window.partitionBy("project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = (
            rest.join(room, "project_id")
            .filter(F.col("bytes") <= F.col("room"))
            .withColumn("small", small)
            .withColumn("sum", F.sum(F.when(F.col("small"), F.col("bytes")).otherwise(0)).over(w))
        )
        ends = F.when(F.col("small"), F.col("sum") * 2 > F.col("room")).otherwise(F.col("sum") + F.col("bytes") <= F.col("room"))
        run = staging.stage(run.withColumn("ends", ends), "budget")
        if run.isEmpty():
            return taken
        last = run.filter("ends").groupBy("project_id").agg(F.min("rank").alias("last"))
        seen = run.join(last, "project_id", "left")
        fits = (F.col("rank") == F.col("last")) | (F.col("small") & (F.col("last").isNull() | (F.col("rank") < F.col("last"))))
        now = staging.stage(seen.filter(fits).select("project_id", "rank", "bytes"), "budget")
        taken = taken.unionByName(now.select("project_id", "rank"))
        added = now.groupBy("project_id").agg(F.sum("bytes").alias("added"))
        spent = spent.join(added, "project_id").select("project_id", (F.col("total") + F.col("added")).cast("long").alias("total"))
        rest = seen.filter(F.col("rank") > F.col("last")).select("project_id", "rank", "bytes")


def index_warnings(
    flags: DataFrame,
    budgeted: DataFrame,
    max_files: int = NO_LIMIT,
    max_file_bytes: int = NO_LIMIT,
    max_total_bytes: int = NO_LIMIT,
) -> DataFrame:
    """One row per warning an index run should report."""
    skips = budgeted.groupBy("project_id").agg(
        F.count_if(F.col("skip_reason") == "oversized").alias("big"),
        F.count_if(F.col("skip_reason") == "byte_budget").alias("over"),
    )

    def counted(n, tail_one, tail_many):
        one = F.concat(n.cast("string"), F.lit(" file was skipped " + tail_one))
        many = F.concat(n.cast("string"), F.lit(" files were skipped " + tail_many))
        return F.when(n == 1, one).when(n > 1, many)

    size_tail = f"the per-file indexing limit ({max_file_bytes} bytes)."
    budget_tail = f"after the repository indexing byte budget ({max_total_bytes} bytes) was reached."
    texts = F.array(
        F.when(
            F.col("hit_max_files"),
            f"Indexing reached the configured file limit ({max_files} supported files). Some files were not indexed.",
        ),
        F.when(
            F.col("hit_max_depth"),
            f"Indexing reached the configured directory depth limit ({dims.MAX_DEPTH}). "
            "Deeply nested files may be omitted.",
        ),
        counted(F.col("big"), f"because it exceeds {size_tail}", f"because they exceed {size_tail}"),
        counted(F.col("over"), budget_tail, budget_tail),
    )
    return flags.join(skips, "project_id", "left").select(
        "project_id", F.explode(F.array_compact(texts)).alias("warning")
    )


def unsupported_languages(files: DataFrame) -> DataFrame:
    """Recognised source languages that are not indexed, with sample files."""
    p = F.col("file_path")
    ext = F.lower(paths.extname(p))
    unsupported = [e for e in dims.LANGUAGE_LABELS if e not in dims.INDEX_EXTENSIONS]
    ignored = rx.test(F.lower(paths.normalize(p)), dims.MIGRATION_SQL)
    found = files.filter(
        ext.isin(unsupported) & ~ignored & _no_excluded_dir(p)
    ).select("project_id", ext.alias("extension"), "file_path")
    keys = ["project_id", "extension"]
    w = Window.partitionBy(*keys).orderBy("file_path")
    samples = (
        found.withColumn("rn", F.row_number().over(w))
        .filter("rn <= 3")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("file_path")).alias("sample_files"))
    )
    counts = found.groupBy(*keys).agg(F.count("*").alias("file_count"))
    label = F.try_element_at(paths.lit_map(dims.LANGUAGE_LABELS), F.col("extension"))
    return counts.join(samples, keys).withColumn("label", label)


def vendored_prefixes(files: DataFrame) -> DataFrame:
    """Directories that hold third-party code, from submodules, remappings and nested repositories."""
    p, c = F.col("file_path"), F.col("content")
    base, folder = paths.basename(p), paths.dirname(p)
    remaps = r"=\s*(lib/[^/'\"]+)"
    found = (
        F.when(p == ".gitmodules", F.transform(rx.extract_all(c, r"^\s*path\s*=\s*(.+)$", 1, "m"), rx.trim))
        .when(p == "foundry.toml", rx.extract_all(c, remaps))
        .when(
            (base == "foundry.toml") & folder.isin(dims.FOUNDRY_SUBDIRS),
            F.transform(rx.extract_all(c, remaps), lambda x: F.concat(folder, F.lit("/"), x)),
        )
        .when(p == "remappings.txt", rx.extract_all(c, r"=\s*(lib/[^/\s]+)", 1, "m"))
    )
    marker = r"^((?:[^/]+/){0,3}[^/]+)/\.git(?:/|\z)"
    nested = F.regexp_extract(p, marker, 1)
    outside_skipped = ~F.arrays_overlap(F.split(nested, "/", -1), paths.strings(dims.VENDOR_SCAN_SKIP_DIRS))
    nested_dirs = F.when((nested != "") & outside_skipped, F.array(nested))
    return (
        files.filter(base.isin(".gitmodules", "foundry.toml", "remappings.txt") | F.contains(p, F.lit("/.git")))
        .select("project_id", F.explode(F.coalesce(found, nested_dirs)).alias("prefix"))
        .distinct()
    )


def flag_vendored(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``is_vendored``: the path equals a vendored prefix or lies below one.

    Every ancestor of a path is a candidate, so the prefix test becomes an equality
    join on (project, ancestor) instead of a range or cross join.
    """
    parts = F.split("file_path", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = (
        files.select("project_id", "file_path", F.explode(ancestors).alias("prefix"))
        .join(prefixes, ["project_id", "prefix"], "left_semi")
        .select("project_id", "file_path")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    return files.join(hits, ["project_id", "file_path"], "left").withColumn(
        "is_vendored", F.coalesce("hit", F.lit(False))
    ).drop("hit")
