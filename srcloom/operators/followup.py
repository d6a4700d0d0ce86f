"""Follow-up questions of a session: pinned sources, boosts and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import citing, paths, questions, sections
from srcloom.operators import fuse, pack
from srcloom.sources import store
from srcloom.staging import stage

# --- fixed values: words that mark sharing and storage code, and sources that distract ---------
PIN_WORDS = r"\b(collab|share|portal|firebase|socket|room|link|encrypt|storage|local)\b"
PIN_SKIP = r"\b(test|spec|changelog)\b"
RELEASE_QUERY = r"\b(changelog|release|version|migration|api change)\b"


def pinned_units(asked: DataFrame, units: DataFrame, most: int = 12) -> DataFrame:
    """Best three units of each session source file, in file order.

    ``asked``: (query_id, project_id, query, source_files), at most ten files each.
    """
    files = asked.select("query_id", "project_id", "query", F.posexplode("source_files").alias("file_pos", "file_path"))
    rows = files.join(units.filter("not is_vendored"), ["project_id", "file_path"])
    n = F.col("end_line") - F.col("start_line") + 1
    kind = F.col("kind")
    text = F.lower(F.concat_ws(" ", "file_path", "name", "code"))
    terms = F.filter(F.split(F.lower("query"), "[^a-z0-9_]+", -1), lambda t: F.length(t) > 3)
    score = (
        F.when(kind.isin("function", "method"), 14)
        .when(kind == "class", F.when(n > 250, -8).otherwise(6))
        .when(kind == "module", F.when(n > 220, -14).otherwise(4))
        .otherwise(0)
        + F.when(n <= 80, 8).when(n <= 180, 3).otherwise(-10)
        + F.size(F.filter(terms, lambda t: F.contains(text, t))) * 4
        + F.when(rx.test(text, PIN_WORDS), 8).otherwise(0)
        + F.when(rx.test(F.lower("file_path"), PIN_SKIP), -30).otherwise(0)
    )
    scored = rows.select("query_id", "project_id", "file_pos", F.col("id").alias("unit_id"), "start_line", "is_vendored", score.alias("pin"))
    in_file = Window.partitionBy("query_id", "file_pos").orderBy(F.desc("pin"), "start_line", "unit_id")
    w = Window.partitionBy("query_id").orderBy("file_pos", "n")
    return (
        scored.withColumn("n", F.row_number().over(in_file))
        .filter("n <= 3")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= most)
        .select(
            "query_id", "project_id", "unit_id", F.lit("pinned").alias("channel"),
            (F.lit(1001.0) - F.col("rank")).alias("score"), "rank", "is_vendored",
        )
    )


def boost_sources(merged: DataFrame, asked: DataFrame, heads: DataFrame) -> DataFrame:
    """Raise units of session files; drop changelogs unless asked for or cited."""
    rows = merged.join(heads.select("project_id", F.col("id").alias("unit_id"), "file_path"), ["project_id", "unit_id"]).join(
        asked.select("query_id", "query", "source_files", "followup"), "query_id"
    )
    cited = F.array_contains("source_files", F.col("file_path"))
    release = rx.test(F.lower("query"), RELEASE_QUERY)
    changelog = rx.test(F.lower("file_path"), dims.CHANGELOG_FILE)
    bonus = F.when(F.col("followup").isin("source_location", "code_explanation"), 14).otherwise(24)
    return (
        rows.filter(cited | release | ~changelog)
        .withColumn("score", F.col("score") + F.when(cited, bonus).otherwise(0))
        .select(merged.columns)
    )


def followup_hits(asked: DataFrame, hits: DataFrame, units: DataFrame, k: int = dims.FUSED_TOP_K) -> DataFrame:
    """Hits for a follow-up: pinned and channel hits, boosted, reranked, pinned first again.

    ``asked`` carries the expanded query, the follow-up intent and the plan features;
    ``hits`` the channel hits of the expanded queries, a stored table. The pinned and the merged hits, a few rows per question that
    later steps read again, are staged, so no plan holds their whole lineage several times.
    """
    order = ["pinned", "exact", "grep", "lexical", "overview"]
    pinned = stage(pinned_units(asked, units), "pinned")
    wants = asked.filter(
        F.col("followup").isin("glossary", "persona_rewrite") | F.col("intent").isin(fuse.OVERVIEW_INTENTS)
    ).select("query_id")
    plain = hits.filter("channel <> 'overview'")
    over = hits.filter("channel = 'overview'").join(wants, "query_id", "left_semi")
    merged = fuse.merge(pinned.unionByName(plain).unionByName(over), 2 * k, order)
    boosted = stage(boost_sources(merged, asked, units.select("project_id", "id", "file_path")), "boosted")
    reranked = fuse.rerank(asked, boosted, units, k)
    again = reranked.select(
        "query_id", "project_id", "unit_id", F.lit("exact").alias("channel"), "score", F.col("rank"), "is_vendored"
    )
    return fuse.merge(pinned.unionByName(again), k, order)


#: Lines of a bucket by which ranges meet units.
LINE_BUCKET = 64


def _buckets(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / LINE_BUCKET), F.floor(F.greatest(start, end) / LINE_BUCKET))


def session_refs(sessions: DataFrame) -> DataFrame:
    """(session_id, project_id, pos, file_path, name, lines) of the sources that sessions keep as JSON."""
    refs = sessions.select("session_id", "project_id", F.posexplode(store.source_refs(F.col("sources_json"))).alias("pos", "r"))
    return refs.select("session_id", "project_id", "pos", "r.file_path", "r.name", "r.lines")


def session_source_units(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Excerpt units of the sources of sessions.

    ``sources``: (session_id, project_id, pos, file_path, name, lines). A range takes its lines from the first unit of the file that
    holds it, else from the first one that overlaps; a source without a range takes the head of the file's module, else of its
    first unit. Ranges meet units over buckets of lines, and a range that many sessions cite is looked up once.
    """
    keys = ["project_id", "file_path"]
    wanted = sources.select(*keys, "lines").distinct()
    start = rx.extract(F.col("lines"), r"^(\d{1,9})(?:-\d{1,9})?$", 1)
    end = F.coalesce(F.nullif(rx.extract(F.col("lines"), r"^\d{1,9}-(\d{1,9})$", 1), F.lit("")), F.nullif(start, F.lit("")))
    parsed = wanted.select(*keys, "lines", F.nullif(start, F.lit("")).cast("int").alias("start"), end.cast("int").alias("end"))
    heads = units.select(*keys, "id", "kind", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    ranged = parsed.filter("start is not null").withColumn("bucket", F.explode(_buckets(F.col("start"), F.col("end"))))
    spread = heads.withColumn("bucket", F.explode(_buckets(F.col("from_line"), F.col("to_line"))))
    inside = (F.col("start") >= F.col("from_line")) & (F.col("end") <= F.col("to_line"))
    overlap = (F.col("from_line") <= F.col("end")) & (F.col("to_line") >= F.col("start"))
    met = ranged.join(spread, [*keys, "bucket"]).filter(inside | overlap)
    best = F.min(F.struct((~inside).cast("int").alias("loose"), "from_line", "id")).alias("b")
    by_range = met.groupBy(*keys, "lines", "start", "end").agg(best).select(*keys, "lines", "start", "end", F.col("b.id").alias("id"))
    first = heads.groupBy(*keys).agg(F.min(F.struct((F.col("kind") != "module").cast("int").alias("loose"), "from_line", "id")).alias("b"))
    by_file = parsed.filter("start is null").join(first, keys).select(*keys, "lines", "start", "end", F.col("b.id").alias("id"))
    picked = stage(by_range.unionByName(by_file), "session-ranges")
    tag = F.concat(F.lit("session-source:"), F.when(F.col("start").isNull(), F.col("id")).otherwise(F.concat("file_path", F.lit(":"), "lines")))
    chosen = picked.join(units.drop("file_path"), ["project_id", "id"])
    ls = F.split("code", "\n", -1)
    skip = F.greatest(F.lit(0), F.col("start") - F.col("start_line"))
    last = F.greatest(skip + 1, F.col("end") - F.col("start_line") + 1)
    excerpt = rx.trim(F.array_join(F.slice(ls, skip + 1, last - skip), "\n"))
    head = F.array_join(F.slice(ls, 1, 40), "\n")
    changed = {
        "unit_id": F.col("id"),
        "id": tag,
        "code": F.when(F.col("start").isNull() | (excerpt == ""), head).otherwise(excerpt),
        "start_line": F.coalesce("start", "start_line"),
        "end_line": F.coalesce("end", "end_line"),
    }
    found = chosen.withColumns(changed).drop("start", "end")
    # A session's sources are made distinct by their tags; the text of a range comes to the rows that are left.
    tagged = sources.select("session_id", *keys, "pos", F.col("name").alias("given"), "lines").join(
        picked.select(*keys, "lines", tag.alias("tag")), [*keys, "lines"]
    )
    once = Window.partitionBy("session_id", "tag").orderBy("pos")
    left = tagged.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n", "tag")
    named = left.join(found, [*keys, "lines"])
    given = (F.col("given") != "") & F.col("id").endswith(F.col("lines")) & (F.col("lines") != "")
    return named.withColumn("name", F.when(given, F.col("given")).otherwise(F.col("name"))).drop("given", "lines")


def citation_sources(ctx: DataFrame, judged: DataFrame) -> DataFrame:
    """Sources of an answer: its context units and the valid cited ranges."""
    base = paths.basename(F.col("file_path"))
    rows = ctx.withColumn("base", base).withColumn(
        "base_units", F.count("*").over(Window.partitionBy("answer_id", "base"))
    )
    own = ctx.select("answer_id", "file_path", "name", "start_line", "end_line", F.lit(0).alias("tier"), F.lit(0).alias("pos"))
    keys = rows.select(
        "answer_id", "file_path", "name", "ord", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(citing.normalize(F.col("file_path")).alias("path"), F.lit(0).alias("loose")),
                    F.when(F.col("base_units") == 1, F.struct(citing.normalize(F.col("base")).alias("path"), F.lit(1).alias("loose"))),
                )
            )
        ).alias("k"),
    ).select("*", "k.path", "k.loose")
    cited = judged.filter("valid and not line_only").select("answer_id", "pos", "path", "start_line", "end_line")
    inside = (F.col("start_line") >= F.col("from_line")) & (F.col("end_line") <= F.col("to_line"))
    found = (
        cited.join(keys, ["answer_id", "path"])
        .filter(inside)
        .groupBy("answer_id", "pos", "start_line", "end_line")
        .agg(F.min_by(F.struct("file_path", "name"), F.struct("loose", "ord")).alias("u"))
        .select("answer_id", "u.file_path", "u.name", "start_line", "end_line", F.lit(1).alias("tier"), (F.col("pos") + 1).alias("pos"))
    )
    both = own.unionByName(found)
    first = both.groupBy("answer_id", "file_path", "start_line", "end_line").agg(F.min_by("name", F.struct("tier", "pos", "name")).alias("name"))
    doc = paths.is_documentation(F.col("file_path"))
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    w = Window.partitionBy("answer_id").orderBy(doc, "file_path", "start_line", "end_line")
    return first.select("answer_id", "file_path", "name", lines.alias("lines"), F.row_number().over(w).alias("ord"))


def overview_statement(units: DataFrame) -> DataFrame:
    """Best describing sentence of a project's overview documents."""
    docs = units.filter(paths.is_overview_doc(F.col("file_path"))).select("project_id", "id", "file_path", "start_line", "end_line", "code")
    paragraphs = docs.select(
        "project_id", "id", "file_path", "start_line", "end_line", F.posexplode(sections.overview_paragraphs(F.col("code"))).alias("pos", "p")
    )
    p = F.col("p")
    noisy = rx.test(p, dims.META_NOISE, "i")
    descriptive = rx.test(F.substring(p, 1, 140), r"\bis (?:a|an|the|now)\b", "i") & ~noisy
    score = sections.overview_score(p)
    rated = paragraphs.withColumn("score", score).withColumn(
        "grade", F.when(F.col("score") > 0, 0).when(descriptive, 1).when(~noisy, 2)
    )
    best = rated.filter("grade is not null").groupBy("project_id", "id", "file_path", "start_line", "end_line").agg(
        F.min_by("p", F.struct("grade", F.when(F.col("grade") == 0, -F.col("score")).otherwise(0).alias("s"), "pos")).alias("p")
    )
    readme = rx.test(F.lower("file_path"), dims.README_FILE)
    w = Window.partitionBy("project_id").orderBy(~readme, "file_path", "start_line", "id")
    return (
        best.withColumn("rn", F.row_number().over(w))
        .filter("rn = 1")
        .select(
            "project_id",
            "id",
            sections.first_sentence(F.col("p")).alias("statement"),
            F.concat(F.lit("["), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]")).alias("citation"),
        )
    )


def followup_budget(max_tokens: int = dims.MAX_CONTEXT_TOKENS) -> int:
    """Tokens of a follow-up's context: 12 % of the whole, 500 at least and 2,400 at most."""
    return min(2400, max(500, max_tokens * 12 // 100))


def pack_followup(
    planned: DataFrame, sources: DataFrame, hits: DataFrame, units: DataFrame, max_tokens: int = dims.MAX_CONTEXT_TOKENS
) -> DataFrame:
    """Context of a follow-up: units of the session's sources before retrieved ones, two of a file at most.

    ``planned``: plan columns of the expanded questions; ``sources``: (query_id, project_id, unit_id, rank) of
    the session's own sources; ``hits``: the same columns of the retrieved units.
    """
    columns = ["query_id", "project_id", "unit_id", "rank"]
    listed = sources.select(*columns, F.lit(0).alias("origin")).unionByName(hits.select(*columns, F.lit(1).alias("origin")))
    once = Window.partitionBy("query_id", "unit_id").orderBy("origin", "rank")
    listed = listed.withColumn("n", F.row_number().over(once)).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "rank", "unit_id"))
    listed = listed.withColumn("ord", place).withColumn("all", F.count("*").over(Window.partitionBy("query_id")))
    standing = F.when(F.col("origin") == 0, 1000.0).otherwise(500.0)
    weighed = listed.select(
        "query_id", "project_id", "unit_id", "ord", (F.col("all") - F.col("ord") + 1 + standing).alias("score"), F.col("ord").alias("rank")
    )
    limits = planned.withColumn("max_tokens", F.lit(followup_budget(max_tokens))).withColumn("max_per_file", F.lit(2))
    candidates = weighed.select("query_id", "project_id", "unit_id", "ord")
    return pack.pack(pack.pack_scores(limits, candidates, weighed.select("query_id", "unit_id", "score", "rank"), units))
