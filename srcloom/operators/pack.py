"""Choosing the code that fits a context window, and laying it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rules, rx
from srcloom.functions import paths, redact, tokens, unittext
from srcloom.operators import fuse, retrieve
from srcloom.operators.walk import count_of, walk

_NO_STRINGS = "array<string>"
MAX_PER_FILE = 5


def context_budget(ratio: Column, max_tokens: int = dims.MAX_CONTEXT_TOKENS) -> Column:
    return F.greatest(F.lit(500), F.floor(ratio * max_tokens)).cast("int")


def unit_limit() -> Column:
    """Most tokens a single unit may take of a context."""
    return F.floor(F.col("max_tokens") * F.lit(0.4).cast("double")).cast("int")


def trim_to_budget(units: DataFrame, group: str, order: str, max_tokens: int) -> DataFrame:
    """Truncate long units, then keep the leading units that fit together."""
    cutted = tokens.with_cut(units, F.lit(int(max_tokens * 0.4)), F.array().cast(_NO_STRINGS)).withColumn(
        "tokens", tokens.estimate(F.col("cut_code"))
    )
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cutted.withColumn("running", F.sum("tokens").over(w))
        .filter(F.col("running") <= max_tokens)
        .withColumns({"code": F.col("cut_code"), "start_line": F.col("cut_start"), "end_line": F.col("cut_end")})
        .drop("cut_code", "cut_start", "cut_end")
    )


# --- neighbours of the retrieved units ------------------------------------------------------


def class_and_method_neighbours(hits: DataFrame, heads: DataFrame) -> DataFrame:
    """Class of a retrieved method and methods of a retrieved class, in hit order.

    ``heads`` are unit columns without the code text.
    """
    keys = ["project_id", "file_path"]
    mine = hits.select("query_id", "project_id", "unit_id", "rank").join(
        heads.select("project_id", F.col("id").alias("unit_id"), "file_path", "kind", "name", "parent_name"),
        ["project_id", "unit_id"],
    )
    classes = (
        heads.filter("kind = 'class'")
        .groupBy("project_id", "file_path", F.col("name").alias("parent_name"))
        .agg(F.min_by("id", F.struct("start_line", "id")).alias("other"), F.min("start_line").alias("line"))
    )
    of_methods = mine.filter("kind = 'method'").join(classes, [*keys, "parent_name"])
    methods = heads.filter("kind = 'method'").select(
        "project_id", "file_path", F.col("parent_name").alias("name"), F.col("id").alias("other"), F.col("start_line").alias("line")
    )
    of_classes = mine.filter("kind = 'class'").join(methods, [*keys, "name"])
    columns = ["query_id", "project_id", "other", "rank", "line"]
    found = of_methods.select(columns).unionByName(of_classes.select(columns))
    fresh = found.join(hits.select("query_id", F.col("unit_id").alias("other")), ["query_id", "other"], "left_anti")
    first = fresh.groupBy("query_id", "project_id", F.col("other").alias("unit_id")).agg(
        F.min(F.struct("rank", "line", "other")).alias("at")
    )
    w = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "project_id", "unit_id", F.row_number().over(w).alias("pos"))


def call_neighbours(hits: DataFrame, heads: DataFrame, included: DataFrame, top: int = 3, most: int = 5) -> DataFrame:
    """Units called by the leading hits: first unit of each called name, five at most.

    ``included`` holds (query_id, unit_id) that are already part of the context.
    """
    leading = hits.filter(F.col("rank") <= top).select("query_id", "project_id", "unit_id", "rank")
    calls = leading.join(
        heads.select("project_id", F.col("id").alias("unit_id"), "called_functions"), ["project_id", "unit_id"]
    ).select("query_id", "project_id", "rank", F.posexplode("called_functions").alias("call_pos", "name"))
    by_name = heads.groupBy("project_id", "name").agg(
        F.min_by("id", F.struct("file_path", "start_line", "id")).alias("unit_id")
    )
    fresh = (
        calls.join(by_name, ["project_id", "name"])
        .join(included, ["query_id", "unit_id"], "left_anti")
        .groupBy("query_id", "project_id", "unit_id")
        .agg(F.min(F.struct("rank", "call_pos")).alias("at"))
    )
    w = Window.partitionBy("query_id").orderBy("at")
    return (
        fresh.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most).select("query_id", "project_id", "unit_id", "pos")
    )


def expand_context(hits: DataFrame, units: DataFrame, max_tokens: int = dims.MAX_CONTEXT_TOKENS) -> DataFrame:
    """Hits plus their neighbours, trimmed to the context size, in order.

    Hits are dropped from the tail until they fit (one always stays), then the
    neighbours, sorted by path, fill what is left.
    """
    heads = units.drop("code", "docstring", "imports", "exported_names")
    related = class_and_method_neighbours(hits, heads)
    included = hits.select("query_id", "unit_id").unionByName(related.select("query_id", "unit_id"))
    called = call_neighbours(hits, heads, included)
    base = hits.select("query_id", "project_id", "unit_id", F.lit(0).alias("tier"), F.col("rank").alias("pos"))
    extra = related.withColumn("tier", F.lit(1)).unionByName(called.withColumns({"tier": F.lit(1), "pos": F.col("pos") + 1000000}))
    # The size of a cut unit does not depend on the question, so no text leaves the unit.
    text = units.select("project_id", F.col("id").alias("unit_id"), "file_path", "code", "start_line", "end_line")
    sizes = tokens.with_cut(text, F.lit(int(max_tokens * 0.4)), F.array().cast(_NO_STRINGS)).select(
        "project_id", "unit_id", "file_path", tokens.estimate(F.col("cut_code")).alias("tokens")
    )
    sized = base.unionByName(extra.select(base.columns)).join(sizes, ["project_id", "unit_id"])
    sort_path = F.when(F.col("tier") == 0, "").otherwise(F.col("file_path"))
    w = Window.partitionBy("query_id", "tier").orderBy(sort_path, "pos").rowsBetween(Window.unboundedPreceding, 0)
    ran = sized.withColumn("running", F.sum("tokens").over(w)).withColumn("nth", F.count("*").over(w))
    kept_primary = (F.col("tier") == 0) & ((F.col("running") <= max_tokens) | (F.col("nth") == 1))
    used = F.sum(F.when(kept_primary, F.col("tokens"))).over(Window.partitionBy("query_id"))
    final = ran.withColumn("used", used).filter(
        kept_primary | ((F.col("tier") == 1) & (F.col("used") + F.col("running") <= max_tokens))
    )
    out = Window.partitionBy("query_id").orderBy("tier", sort_path, "pos")
    return final.select("query_id", "project_id", "unit_id", F.row_number().over(out).alias("ord"))


# --- packing ----------------------------------------------------------------------------------


def pack_scores(features: DataFrame, candidates: DataFrame, hits: DataFrame, units: DataFrame) -> DataFrame:
    """Score, size and evidence of every context candidate.

    ``features``: fuse.with_features plus the plan columns and ``max_tokens``;
    ``candidates``: (query_id, project_id, unit_id, ord); ``hits``: (query_id,
    unit_id, score, rank). The code text is read once and does not leave this step.
    """
    best = hits.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    retrieved = hits.select("query_id", "unit_id", F.col("score").alias("hit_score"), F.col("rank").alias("hit_rank"))
    judged = retrieve.with_support(fuse.with_marks(units))
    rows = (
        candidates.join(retrieved, ["query_id", "unit_id"], "left")
        .join(best, "query_id", "left")
        .join(fuse.with_asked(features).drop("project_id", "low_query"), "query_id")
        .join(judged.withColumnRenamed("id", "unit_id"), ["project_id", "unit_id"])
    )
    low_path, low_name = F.lower("file_path"), F.lower("name")
    exports = F.transform("exported_names", F.lower)

    def evidence(code: Column) -> Column:
        low_code = F.lower(code)
        return F.exists("paths", lambda p: F.endswith(low_path, p)) | F.exists(
            "needles", lambda n: F.contains(low_code, n) | F.contains(low_path, n)
        )

    metadata = F.aggregate(
        "terms",
        F.lit(0),
        lambda acc, t: acc
        + F.when(low_name == t, 10).when(F.contains(low_name, t), 4).otherwise(0)
        + F.when(F.contains(low_path, t), 3).otherwise(0)
        + F.when(F.array_contains(exports, t), 5).otherwise(0),
    )
    support = F.when(F.col("asks_support"), F.col("support")).otherwise(0)
    cols = {"path": F.col("file_path"), "path_lower": low_path}
    plan = F.lit(0)
    for points, column, value, cond in dims.PLAN_BONUS:
        plan = plan + F.when(F.array_contains(column, value) & rules.holds(cond, cols), points).otherwise(0)
    boost = F.when(F.col("best") > 0, F.coalesce("hit_score", F.lit(0.0)) / F.col("best") * 20).otherwise(0.0)
    score = (
        boost
        + metadata
        + F.when(evidence(F.col("code")), 20).otherwise(0)
        + support
        + fuse.total(fuse.workflow_rules("packer"))
        + plan
        + fuse.test_penalty(120)
        + unittext.kind_priority()
        + F.when(F.size("exported_names") > 0, 1.5).otherwise(0.0)
        + F.when(F.col("is_vendored"), -10).otherwise(0)
        - (F.col("ord") - 1) * F.lit(0.001).cast("double")
    )
    scored = rows.withColumn("pack_score", score)
    return tokens.with_cut(scored, unit_limit(), F.col("needles")).select(
        "query_id",
        "project_id",
        "unit_id",
        "ord",
        "file_path",
        "pack_score",
        F.col("cut_start").alias("start_line"),
        F.col("cut_end").alias("end_line"),
        tokens.estimate(F.col("cut_code")).alias("tokens"),
        evidence(F.col("cut_code")).alias("exact"),
        "hit_rank",
        "max_tokens",
        "max_per_file",
    )


def drop_hopeless(scored: DataFrame) -> DataFrame:
    """Remove candidates that the greedy walk can never keep.

    Among candidates of one question, file, size and evidence class, all behind the
    first few are hopeless, where few is the most that one file may give: each of these is
    either kept, which fills the file, or rejected, which rejects its equals too. What is left for a walk is then
    bounded by the files and sizes, not by the number of units.
    """
    w = Window.partitionBy("query_id", "file_path", "tokens", "exact").orderBy(F.desc("pack_score"), "ord")
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.greatest(F.col("max_per_file"), F.lit(MAX_PER_FILE))).drop("rn")


def pack(scored: DataFrame) -> DataFrame:
    """Greedy choice per question over ids and sizes, then the final order."""

    def fits(kept, total, row):
        limit = F.when(row["exact"], F.greatest(row["max_per_file"], F.lit(MAX_PER_FILE))).otherwise(row["max_per_file"])
        return (total + row["tokens"] <= row["max_tokens"]) & (count_of(kept, "file_path", row["file_path"]) < limit)

    kept = walk(drop_hopeless(scored), ["query_id"], [-F.col("pack_score"), F.col("ord")], F.col("tokens"), fits)
    rank = F.coalesce("hit_rank", F.lit(2**31 - 1))
    w = Window.partitionBy("query_id").orderBy(
        F.desc(F.floor(F.col("pack_score") / 5)), rank, "file_path", "start_line", "ord"
    )
    return kept.withColumn("slot", F.row_number().over(w)).drop("max_tokens", "max_per_file")


def context_text(packed: DataFrame, features: DataFrame, units: DataFrame) -> DataFrame:
    """Packed units with the code a reader sees."""
    rows = packed.select("query_id", "project_id", "unit_id", "slot").join(
        features.select("query_id", "needles", "max_tokens"), "query_id"
    ).join(
        units.select("project_id", F.col("id").alias("unit_id"), "file_path", "name", "kind", "language", "docstring", "code", "start_line", "end_line"),
        ["project_id", "unit_id"],
    )
    return tokens.with_cut(rows, unit_limit(), F.col("needles")).select(
        "query_id", "project_id", "unit_id", "slot", "file_path", "name", "kind", "language", "docstring",
        F.col("cut_code").alias("code"), F.col("cut_start").alias("start_line"), F.col("cut_end").alias("end_line"),
    )


def context_lines(packed: DataFrame, units: DataFrame) -> DataFrame:
    """Packed units with the lines they were cut to, without their code."""
    heads = units.select("project_id", F.col("id").alias("unit_id"), "name", "kind", "language", "docstring")
    return packed.select("query_id", "project_id", "unit_id", "slot", "file_path", "start_line", "end_line").join(
        heads, ["project_id", "unit_id"]
    )


def citation_tag() -> Column:
    return F.concat(
        F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")
    )


def unit_block() -> Column:
    """A context unit as a heading with its citation tag and a fenced, redacted body."""
    language = F.coalesce(
        F.nullif(F.substring(F.regexp_replace("language", "[^A-Za-z0-9_-]", ""), 1, 40), F.lit("")), F.lit("text")
    )
    body = F.replace(redact.redact_text(F.col("file_path"), F.col("code")), F.lit("```"), F.lit("``\\`"))
    return F.concat(
        F.lit("### "), citation_tag(), F.lit(" - "), F.col("kind"), F.lit(" "), F.col("name"), F.lit("\n```"), language,
        F.lit("\n"), body, F.lit("\n```"),
    )


def format_context(context: DataFrame) -> DataFrame:
    """One context document per question: the allowed citations, then the sources."""
    menu = F.concat(F.lit("- ["), citation_tag(), F.lit("] "), F.col("kind"), F.lit(" "), F.col("name"))
    rows = context.select("query_id", "slot", menu.alias("menu"), unit_block().alias("block"))
    # A packed context holds a bounded number of tokens, so one row per question is safe.
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "menu", "block"))).alias("r"))
    return ordered.select(
        "query_id",
        F.concat(
            F.lit("## Allowed Citations\n"), F.array_join("r.menu", "\n"), F.lit("\n\n"), F.array_join("r.block", "\n\n")
        ).alias("context"),
    )


def source_list(context: DataFrame) -> DataFrame:
    """Sources of a context: code before documentation, then path and line."""
    doc = paths.is_documentation(F.col("file_path"))
    w = Window.partitionBy("query_id").orderBy(doc, "file_path", "start_line", "slot")
    return context.select(
        "query_id",
        "file_path",
        "name",
        "kind",
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        F.row_number().over(w).alias("ord"),
    )


def fallback_answer(queries: DataFrame, context: DataFrame) -> DataFrame:
    """Answer made of the first four context units, for use when generation fails."""
    stock = F.concat("kind", F.lit(" "), "name", F.lit(" is available as source evidence for this follow-up question."))
    summary = F.coalesce(F.nullif(rx.trim(F.col("docstring")), F.lit("")), stock)
    line = F.concat(F.lit("- "), summary, F.lit(" ["), citation_tag(), F.lit("]"))
    lines = (
        context.filter("slot <= 4")
        .select("query_id", "slot", line.alias("line"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "line"))).alias("r"))
        .select("query_id", F.array_join("r.line", "\n").alias("answer"))
    )
    none = "The provided context does not include enough source evidence to answer this question."
    return queries.select("query_id").join(lines, "query_id", "left").fillna(none, ["answer"])
