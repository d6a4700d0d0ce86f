"""Evidence planning for a project briefing.

Section and rule tables are fixed and small, so a unit is scored against all of
them in its own row; only ids, paths and scores are ranked and shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rules, rx
from srcloom.functions import paths, tokens, unittext
from srcloom.functions.lists import rows_of
from srcloom.operators.walk import count_of, walk
from srcloom.staging import stage

P = "file_path"
HINTS = {s: h for s, h, _ in dims.SECTIONS}
HEAD = ["project_id", "id", "file_path", "name", "kind", "start_line", "end_line", "is_vendored"]


def usable(units: DataFrame) -> DataFrame:
    return units.filter(paths.is_usable(P, F.col("is_vendored")))


def section_query(section: str) -> str:
    return f"Sections: {section}. Evidence to retrieve: {HINTS[section]}."


def section_terms(section: str) -> list[str]:
    words = re.split(r"[^a-z0-9]+", f"{section} {HINTS[section]}".lower())
    return list(dict.fromkeys(w for w in words if len(w) >= 3))


def _order(*first: Column) -> list[Column]:
    return [*first, P, F.col("start_line"), F.col("id")]


def _top(df: DataFrame, keys: list[str], n: int, *first: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_order(*first))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# --- census, entities, product signals -------------------------------------------------------------


def census(units: DataFrame) -> DataFrame:
    ok = paths.is_usable(P, F.col("is_vendored"))
    return units.groupBy("project_id").agg(
        F.count("*").alias("total_units"),
        F.count_distinct("file_path").alias("total_files"),
        F.count_if(ok).alias("usable_units"),
        F.count_distinct(F.when(paths.is_noise(P), F.col(P))).alias("noise_files"),
    )


def bucket_census(units: DataFrame) -> DataFrame:
    """Units, files and the first five sample files of each evidence bucket."""
    rows = rows_of(usable(units), ["project_id", "file_path", "start_line"], paths.evidence_buckets(P), "bucket")
    keys = ["project_id", "bucket"]
    files = rows.groupBy(*keys, "file_path").agg(F.count("*").alias("n"))
    counts = files.groupBy(*keys).agg(F.sum("n").alias("unit_count"), F.count("*").alias("file_count"))
    w = Window.partitionBy(*keys).orderBy("file_path")
    samples = (
        files.withColumn("rn", F.row_number().over(w))
        .filter("rn <= 5")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("file_path")).alias("sample_files"))
    )
    return counts.join(samples, keys)


def domain_entities(units: DataFrame, n: int = 14) -> DataFrame:
    """Type and model names declared in a project, the most telling ones."""
    forms = [(0, dims.MODEL_ENTITY), (1, dims.TYPE_ENTITY)]

    def names(form, pattern):
        entry = lambda name, i: F.struct(F.lit(form).alias("form"), i.alias("pos"), name.alias("name"))
        return F.transform(rx.extract_all(F.col("code"), pattern), entry)

    found = F.concat(*[names(form, pattern) for form, pattern in forms])
    heads = ["project_id", "id", "file_path", "start_line", "end_line"]
    rows = rows_of(usable(units), heads, found, "e").select(
        *heads, "e.form", "e.pos", F.col("e.name").alias("name")
    ).filter("form = 0 or length(name) >= 3")
    cols = {"path_lower": F.lower(P), "entity_text": F.lower(F.concat_ws(" ", "name", "file_path"))}
    score = F.lit(20) + rules.points(dims.ENTITY_POINTS, cols) - F.when(F.col("form") == 1, 12).otherwise(0)
    best = Window.partitionBy("project_id", "name").orderBy(F.desc("score"), "file_path", "start_line", "id", "form", "pos")
    w = Window.partitionBy("project_id").orderBy(F.desc("score"), "name")
    category = None
    for label, pattern in dims.ENTITY_CATEGORIES:
        hit = rx.test(F.lower("name"), pattern)
        category = F.when(hit, label) if category is None else category.when(hit, label)
    return (
        rows.withColumn("score", score)
        .withColumn("rn", F.row_number().over(best))
        .filter("rn = 1")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(
            "project_id",
            "name",
            category.otherwise("domain").alias("category"),
            "file_path",
            F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
            "score",
            "rank",
            "id",
        )
    )


def product_signals(units: DataFrame, entities: DataFrame, n: int = 8) -> DataFrame:
    """Product words of a project by weighted use in its texts and entity names."""
    boost = F.when(paths.is_documentation(P), 4).otherwise(1)
    # One pass over a text finds the uses of all words.
    # Every use starts and ends with a letter, so each edge of a word needs one look only.
    words = rx.extract_all(unittext.workflow_text(), rf"(?<!\w)({'|'.join(dims.PRODUCT_TERMS)})s?(?!\w)")
    # No filter on the words: it would be put before them, with a pass of its own.
    counted = usable(units).select("project_id", boost.alias("boost"), words.alias("words"))

    def uses(term):
        return F.least(F.lit(12), F.size(F.filter("words", lambda w: w == term))) * F.col("boost")

    sums = counted.groupBy("project_id").agg(*[F.sum(uses(term)).alias(term) for term in dims.PRODUCT_TERMS])
    long = sums.select(
        "project_id",
        F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("points")) for t in dims.PRODUCT_TERMS])).alias("x"),
    ).select("project_id", "x.term", F.col("x.points").cast("bigint").alias("points"))
    named = entities.select(
        "project_id",
        F.explode(F.filter(paths.strings(dims.PRODUCT_TERMS), lambda t: F.contains(F.lower("name"), t))).alias("term"),
        F.lit(20).cast("bigint").alias("points"),
    )
    total = long.unionByName(named).groupBy("project_id", "term").agg(F.sum("points").alias("score")).filter("score > 0")
    w = Window.partitionBy("project_id").orderBy(F.desc("score"), "term")
    return (
        total.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select("project_id", F.initcap("term").alias("signal"), "score", "rank")
    )


# --- bucket evidence -----------------------------------------------------------------------------------


def bucket_scores(units: DataFrame) -> DataFrame:
    """Usable units with one row per evidence bucket of their path and its score."""
    low = F.lower(P)
    cols = {"path_lower": low}
    bucket = F.col("bucket")
    score = F.lit(100) + F.col("path_points")
    for pattern, buckets, inside, outside in dims.BUCKET_PATH_WEIGHTS:
        score = score + F.when(rx.test(low, pattern), F.when(bucket.isin(buckets), inside).otherwise(outside)).otherwise(0)
    overview = bucket == "overview_docs"
    narrow_in, narrow_out = dims.NARROW_DOC_POINTS
    depth = F.size(F.split(P, "/", -1))
    score = (
        score
        + F.when(paths.is_narrow_reference_doc(P), F.when(overview, narrow_in).otherwise(narrow_out)).otherwise(0)
        + F.when(F.col("kind") == "module", 20).otherwise(0)
        + F.when(paths.is_documentation(P), F.when(overview, 20).otherwise(-12)).otherwise(0)
        - F.least(F.lit(25), F.greatest(F.lit(0), depth - 4) * 3)
    )
    rows = rows_of(
        usable(units), [*HEAD, rules.points(dims.PATH_WEIGHTS, cols).alias("path_points")], paths.evidence_buckets(P), "bucket"
    )
    return rows.withColumn("score", score).drop("path_points")


def _directory_key(p: Column) -> Column:
    parts = F.split(p, "/", -1)
    deep = F.get(parts, 0).isin(dims.DEEP_DIRECTORY_ROOTS)
    keep = F.least(F.size(parts) - 1, F.when(deep, 3).otherwise(2))
    return F.when(F.size(parts) <= 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), keep), "/"))


def bucket_selection(scored: DataFrame) -> DataFrame:
    """Greedy choice per bucket with a cap per directory and per file stem.

    A bucket keeps six units at most, hence at most three directories and six stems
    can fill up. Rows that this makes hopeless are dropped by ranks before the walk:
    beyond two per (directory, stem), sixteen per directory, ten per stem and 128 in
    all. The walk over one bucket is therefore bounded and still exact.
    """
    budget = F.try_element_at(paths.lit_map(dims.BUCKET_BUDGETS), F.col("bucket"))
    flow = F.lower(F.regexp_replace(paths.basename(P), r"\.[^.]+\z", ""))
    rows = scored.withColumns(
        {
            "dir": _directory_key(P),
            "flow": flow,
            "dir_max": F.when(F.col("bucket").isin("api_handlers", "data_model"), 4).otherwise(2),
            "flow_max": F.when(F.startswith(flow, F.lit("export-")), 1).otherwise(2),
            "budget": F.coalesce(budget, F.lit(2)),
        }
    )
    group = ["project_id", "bucket"]
    for keys, n in ((["dir", "flow"], 2), (["dir"], 16), (["flow"], 10), ([], 128)):
        w = Window.partitionBy(*group, *keys).orderBy(*_order(F.desc("score")))
        rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)

    def fits(kept, total, row):
        return (total < row["budget"]) & (count_of(kept, "dir", row["dir"]) < row["dir_max"]) & (count_of(kept, "flow", row["flow"]) < row["flow_max"])

    picked = walk(rows, group, [F.col("place")], F.lit(1), fits)
    w = Window.partitionBy(*group).orderBy("place")
    return picked.withColumn("pos", F.row_number().over(w)).drop("dir", "flow", "dir_max", "flow_max", "budget", "place")


def product_overview(scored: DataFrame, n: int = 2) -> DataFrame:
    """Leading overview documents for the sections that describe the product."""
    docs = scored.filter((F.col("bucket") == "overview_docs") & paths.is_overview_doc(P))
    top = _top(docs, ["project_id"], n, F.desc("score"))
    wanted = [s for s in dims.SECTION_BUCKETS if re.search(dims.PRODUCT_SECTION, s, re.I)]
    return top.select("*", F.explode(paths.strings(wanted)).alias("section"))


def code_grounding(scored: DataFrame, n: int = 4) -> DataFrame:
    """Leading source units by their best grounding bucket, per section."""
    pairs = [
        (s, b) for s, buckets in dims.SECTION_BUCKETS.items() for b in buckets if b in dims.GROUNDING_BUCKETS
    ]
    by_bucket = {b: [s for s, x in pairs if x == b] for b in dims.GROUNDING_BUCKETS}
    sections = reduce(
        lambda acc, kv: F.when(F.col("bucket") == kv[0], paths.strings(kv[1])).otherwise(acc), by_bucket.items(), F.lit(None)
    )
    best = (
        scored.filter(~paths.is_documentation(P))
        .select(*HEAD, "score", F.explode(sections).alias("section"))
        .groupBy("section", *HEAD)
        .agg(F.max("score").alias("score"))
    )
    return _top(best, ["project_id", "section"], n, F.desc("score"))


def evidence_plan(scored: DataFrame) -> DataFrame:
    """Units planned for each section: overview, grounding, then bucket choices.

    Three steps read the scores of the paths, so these are staged.
    """
    scored = stage(scored, "bucket-scores")
    columns = ["project_id", "section", "id", "file_path"]
    overview = product_overview(scored).select(*columns, F.lit(0).alias("tier"), F.col("rank").alias("place"))
    ground = code_grounding(scored).select(*columns, F.lit(1).alias("tier"), F.col("rank").alias("place"))
    spots = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(b).alias("bucket"), F.lit(i).alias("place"))
            for s, buckets in dims.SECTION_BUCKETS.items()
            for i, b in enumerate(buckets)
        ]
    )
    chosen = (
        bucket_selection(scored)
        .select("project_id", "id", "file_path", "bucket", "pos", F.explode(F.filter(spots, lambda s: s["bucket"] == F.col("bucket"))).alias("s"))
        .select("project_id", "s.section", "id", "file_path", F.lit(2).alias("tier"), (F.col("s.place") * 1000 + F.col("pos")).alias("place"))
    )
    pool = overview.unionByName(ground).unionByName(chosen)
    first = pool.groupBy(*columns).agg(F.min(F.struct("tier", "place")).alias("at"))
    w = Window.partitionBy("project_id", "section").orderBy("at", "id")
    return first.withColumn("ord", F.row_number().over(w)).drop("at")


def missing_buckets(plan: DataFrame, projects: DataFrame) -> DataFrame:
    """Required buckets that no planned unit of the section covers."""
    required = projects.select(
        "project_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(b).alias("bucket"))
                    for s, buckets in dims.SECTION_BUCKETS.items()
                    for b in buckets
                ]
            )
        ).alias("r"),
    ).select("project_id", "r.*")
    covered = plan.select("project_id", "section", F.explode(paths.evidence_buckets(P)).alias("bucket")).distinct()
    return required.join(covered, ["project_id", "section", "bucket"], "left_anti")


def overview_intro(units: DataFrame, n: int = 2) -> DataFrame:
    docs = units.filter(paths.is_overview_doc(P)).select(*HEAD)
    readme = rx.test(F.lower(P), dims.README_ANYWHERE)
    w = Window.partitionBy("project_id").orderBy(~readme, "start_line", "file_path", "id")
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def section_evidence(plan: DataFrame, units: DataFrame, limit: int = dims.SECTION_EVIDENCE_LIMIT) -> DataFrame:
    """Planned units of a section reranked by the words of the section."""
    terms = reduce(
        lambda acc, s: F.when(F.col("section") == s, paths.strings(section_terms(s))).otherwise(acc), dims.SECTION_BUCKETS, F.lit(None)
    )
    rows = plan.select("project_id", "section", "id", "ord").join(
        units.select("project_id", "id", "file_path", "name", "exported_names", "code"), ["project_id", "id"]
    ).withColumn("terms", terms)
    low_name, low_path, low_code = F.lower("name"), F.lower(P), F.lower("code")

    def add(acc, t):
        return (
            acc
            + F.when(F.contains(low_name, t), 5).otherwise(0)
            + F.when(F.contains(low_path, t), 4).otherwise(0)
            + F.when(F.exists("exported_names", lambda e: F.contains(F.lower(e), t)), 3).otherwise(0)
            + F.when(F.contains(low_code, t), 1).otherwise(0)
        )

    score = (
        F.aggregate("terms", F.lit(0), add)
        + F.when(paths.is_overview_doc(P), 2).otherwise(0)
        + F.when(F.array_contains(paths.evidence_buckets(P), "workflow_jobs"), 2).otherwise(0)
    )
    scored = rows.select("project_id", "section", "id", "ord", score.alias("score"), tokens.estimate(F.col("code")).alias("tokens"))
    w = Window.partitionBy("project_id", "section").orderBy(F.desc("score"), "tokens", "ord")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


# --- central files, grounding signals, lifecycle and workflows -------------------------------------------


def _list_points(column: str, each: int, most: int) -> Column:
    return F.least(F.lit(most), F.size(column) * each)


def _text_columns() -> dict[str, Column]:
    return {"path": P, "path_lower": F.lower(P), "wtext": F.col("wtext")}


def _modules(units: DataFrame) -> DataFrame:
    return usable(units).filter("kind = 'module'").withColumn("wtext", unittext.workflow_text())


def central_files(units: DataFrame, n: int = 12) -> DataFrame:
    """File anchors that hold a project together, with the four main reasons."""
    cols = _text_columns()
    table = [(F.lit(16), "file-level module anchor")]
    fixed = [(F.when(rules.holds(c, cols), p).otherwise(0), r) for p, r, c in dims.CENTRAL_RULES]
    table += fixed[:2]
    table += [
        (_list_points("imports", 6, 36), "imports other project code or dependencies"),
        (_list_points("exported_names", 4, 24), "exports reusable symbols"),
        (_list_points("called_functions", 3, 40), "coordinates function calls"),
    ]
    table += fixed[2:]
    # The rules of a unit are judged once; score and reasons are read from the list of their points.
    points = F.array(*[F.struct((-pts).alias("o"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, (pts, r) in enumerate(table)])

    def judged(p):
        main = F.slice(F.array_sort(F.filter(p, lambda x: x["o"] < 0)), 1, 4)
        return F.struct(F.aggregate(p, F.lit(0), lambda total, x: total - x["o"]).alias("score"), main["r"].alias("reasons"))

    # A filter on a column that explode makes is not moved below it, where it would judge all rules again.
    each = _modules(units).select(*HEAD, points.alias("points")).select(*HEAD, F.explode(F.transform(F.array("points"), judged)).alias("j"))
    return _top(each.select(*HEAD, "j.score", "j.reasons").filter("score > 0"), ["project_id"], n, F.desc("score"))


def grounding_signals(units: DataFrame, n: int = 5) -> DataFrame:
    """Evidence for the four grounding signals."""
    low = F.lower(P)
    base = _list_points("called_functions", 2, 18) + _list_points("imports", 2, 12)
    signals = F.array(
        *[
            F.struct(
                F.lit(label).alias("signal"),
                (
                    F.when(rx.test(F.col("wtext"), text), 50).otherwise(0) + F.when(rx.test(low, path), 25).otherwise(0) + base
                ).alias("score"),
            )
            for label, text, path in dims.GROUNDING_SIGNALS
        ]
    )
    rows = _modules(units).select(*HEAD, F.explode(signals).alias("s")).select(*HEAD, "s.signal", "s.score").filter("score > 0")
    return _top(rows, ["project_id", "signal"], n, F.desc("score"))


def _mentioned(text: Column, words) -> Column:
    return F.size(F.filter(paths.strings(words), lambda w: F.contains(text, w)))


def _shared_buckets(wanted) -> Column:
    return F.size(F.array_intersect(F.col("buckets"), paths.strings(wanted)))


def lifecycle_evidence(units: DataFrame) -> DataFrame:
    """Best units of the four lifecycle rules; a unit counts for its first rule."""
    low = F.lower(P)
    cols = {"path_lower": low}
    base = rules.points(dims.LIFECYCLE_PATHS, cols) + F.when(F.col("kind") == "module", 8).otherwise(0)
    rows = usable(units).withColumns(
        {"wtext": unittext.workflow_text(), "buckets": paths.evidence_buckets(P), "base": base, "low": low}
    )

    def score(path_terms, code_terms, buckets):
        out = (
            _mentioned(F.col("low"), path_terms) * 22
            + F.least(F.lit(6), _mentioned(F.col("wtext"), code_terms)) * 5
            + _shared_buckets(buckets) * 16
            + F.col("base")
        )
        if "data_model" in buckets:
            out = out + F.when(rx.test(F.col("low"), dims.LIFECYCLE_MODEL_PATH), 10).otherwise(0)
        return out

    scores = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(most).alias("most"), score(p, c, b).alias("score"))
            for i, (label, most, p, c, b) in enumerate(dims.LIFECYCLE_RULES)
        ]
    )
    long = rows.select(*HEAD, F.explode(scores).alias("s")).select(*HEAD, "s.*").filter("score > 0")
    most = max(r[1] for r in dims.LIFECYCLE_RULES)
    top = _top(long, ["project_id", "rule"], most, F.desc("score")).filter("rank <= most")
    first = Window.partitionBy("project_id", "id").orderBy("rule")
    w = Window.partitionBy("project_id").orderBy("rule", "rank")
    return (
        top.withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .withColumn("pos", F.row_number().over(w))
        .select("project_id", "id", "file_path", "label", "score", "pos")
    )


def workflow_scores(units: DataFrame, entities: DataFrame) -> DataFrame:
    """Usable units scored against every workflow; scores above 12 only."""
    names = entities.groupBy("project_id").agg(F.array_sort(F.collect_list(F.lower("name"))).alias("entities"))
    buckets = paths.evidence_buckets(P)
    layer = reduce(
        lambda acc, kv: F.when(F.array_contains("buckets", kv[0]), kv[1]).otherwise(acc), reversed(dims.LAYERS), F.lit("support")
    )
    rows = (
        usable(units)
        .select(*HEAD, unittext.workflow_text().alias("wtext"), F.lower(P).alias("low"), F.lower("name").alias("low_name"), buckets.alias("buckets"))
        .join(names, "project_id", "left")
        .withColumns({"layer": layer, "entities": F.coalesce("entities", F.array().cast("array<string>"))})
    )

    def score(wid, terms, patterns, wanted, core):
        relevant = F.filter("entities", lambda e: F.exists(paths.strings(core), lambda c: F.contains(e, c)))
        named = F.size(F.filter(relevant, lambda e: F.contains(F.col("low"), e) | F.contains(F.col("wtext"), e)))
        out = (
            _shared_buckets(wanted) * 18
            + reduce(lambda a, b: a + b, [F.when(rx.test(F.col("low"), p), 22).otherwise(0) for p in patterns])
            + _mentioned(F.col("low"), terms) * 12
            + _mentioned(F.col("low_name"), terms) * 8
            + _mentioned(F.col("wtext"), terms) * 2
            + named * 12
            + F.when(F.col("kind") == "module", 4).otherwise(0)
            + F.when(rx.test(F.col("low"), dims.README_FILE), 5).otherwise(0)
        )
        if wid != "viewer-analytics":
            out = out - F.when(rx.test(F.col("low"), r"/export-[^/]+"), 30).otherwise(0)
        return out

    scores = F.array(
        *[
            F.struct(F.lit(wid).alias("workflow"), F.lit(name).alias("title"), score(wid, terms, pats, wanted, core).alias("score"))
            for wid, name, terms, pats, wanted, core in dims.WORKFLOWS
        ]
    )
    return rows.select(*HEAD, "layer", F.explode(scores).alias("s")).select(*HEAD, "layer", "s.*").filter("score > 12")


def workflow_evidence(scored: DataFrame, n: int = 6) -> DataFrame:
    """Evidence of each workflow.

    A unit is passed over when both its file and its layer were seen. The layer
    depends on the path alone, so this keeps the best unit of each file.
    """
    keys = ["project_id", "workflow", "title"]
    per_file = _top(scored, [*keys, "file_path"], 1, F.desc("score"))
    return _top(per_file.drop("rank"), keys, n, F.desc("score"))


def workflow_traces(scored: DataFrame, signals: DataFrame, n: int = 6) -> DataFrame:
    """Ranked workflows of a project with the layers they touch."""
    keys = ["project_id", "workflow", "title"]
    strength = _top(scored, keys, 8, F.desc("score")).groupBy(*keys).agg(F.sum("score").alias("strength"))
    evidence = workflow_evidence(scored).groupBy(*keys).agg(
        F.count("*").alias("n_evidence"), F.array_sort(F.collect_set("layer")).alias("layers")
    )
    words = signals.groupBy("project_id").agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_list("signal")))).alias("words"))
    rows = strength.join(evidence, keys).join(words, "project_id", "left").fillna("", ["words"])
    bonus = F.lit(0)
    for wid, pattern, hit, miss in dims.PRIORITY_RULES:
        bonus = bonus + F.when(F.col("workflow") == wid, F.when(rx.test(F.col("words"), pattern), hit).otherwise(miss)).otherwise(0)
    w = Window.partitionBy("project_id").orderBy(F.desc("priority"), "title")
    return (
        rows.withColumn("priority", F.col("strength") + bonus)
        .filter("n_evidence >= 2 and priority > 25")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(*keys, "priority", "n_evidence", "layers", "rank")
    )


def central_evidence(central, units, lifecycle, entities, scored, traces, n: int = 36) -> DataFrame:
    """Ordered, distinct union of the planned evidence of a project."""
    columns = ["project_id", "id"]
    c = central.select(*columns, F.lit(0).alias("tier"), F.col("rank").alias("place"))
    root = usable(units).filter(rx.test(F.lower(P), r"^readme\.mdx?$|^package\.json$")).select(*HEAD)
    r = _top(root, ["project_id"], n).select(*columns, F.lit(1).alias("tier"), F.col("rank").alias("place"))
    life = lifecycle.select(*columns, F.lit(2).alias("tier"), F.col("pos").alias("place"))
    e = entities.select(*columns, F.lit(3).alias("tier"), F.col("rank").alias("place"))
    ev = workflow_evidence(scored).select("project_id", "workflow", "id", F.col("rank").alias("at"))
    t = ev.join(traces.select("project_id", "workflow", F.col("rank").alias("wrank")), ["project_id", "workflow"])
    t = t.select(*columns, F.lit(4).alias("tier"), (F.col("wrank") * 1000 + F.col("at")).alias("place"))
    first = c.unionByName(r).unionByName(life).unionByName(e).unionByName(t).groupBy(*columns).agg(
        F.min(F.struct("tier", "place", "id")).alias("at")
    )
    w = Window.partitionBy("project_id").orderBy("at")
    return first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select(*columns, "pos")


# --- briefing retrieval -------------------------------------------------------------------------------------


def section_queries(sessions: DataFrame) -> DataFrame:
    """Sections of each session's audience with their query and terms.

    ``sessions``: (session_id, role). Unknown roles use the general plan.
    """
    def rows(role):
        return F.array(
            *[
                F.struct(F.lit(i + 1).alias("part"), F.lit(s).alias("section"), F.lit(HINTS[s]).alias("hint"), F.lit(kind).alias("fallback_kind"))
                for i, part in enumerate(dims.AUDIENCE_PLANS[role])
                for s in part
                for kind in [next(k for name, _, k in dims.SECTIONS if name == s)]
            ]
        )

    plan = rows("general")
    for role in dims.AUDIENCE_PLANS:
        plan = F.when(F.col("role") == role, rows(role)).otherwise(plan)
    out = sessions.select("session_id", "role", F.explode(plan).alias("p")).select("session_id", "role", "p.*")
    words = F.split(F.lower(F.concat_ws(" ", "section", "hint")), "[^a-z0-9]+", -1)
    return out.withColumn("terms", F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def _briefing_static() -> Column:
    """Points of a unit that no query changes."""
    low, text = F.col("low"), F.col("text")
    term_points = reduce(
        lambda a, b: a + b,
        [
            F.when(F.contains(low, F.lit(t)) | F.contains(F.lower("name"), F.lit(t)), 10)
            .when(F.contains(text, F.lit(t)), 3)
            .otherwise(0)
            for t in dims.BRIEFING_WORKFLOW_TERMS
        ],
    )
    return (
        F.when(paths.is_test_file(P), -30).otherwise(0)
        + F.when(paths.is_documentation(P), F.when(rx.test(low, r"^readme\.md$"), 44).otherwise(24)).otherwise(0)
        + F.when(paths.is_package_boundary(P), 22).otherwise(0)
        + F.when(rx.test(low, r"^(src|app|apps|packages)/"), 8).otherwise(0)
        + F.when(F.col("kind") == "module", 5).when(F.col("kind").isin("class", "function"), 3).otherwise(0)
        + term_points
        + unittext.length_penalty()
    )


def _briefing_rows(units: DataFrame) -> DataFrame:
    rows = units.filter(~F.col("is_vendored") & ~paths.is_noise(P))
    return rows.withColumns({"low": F.lower(P), "text": unittext.briefing_text()})


def _product_terms(text: Column) -> Column:
    return F.filter(paths.strings(dims.BRIEFING_PRODUCT_TERMS), lambda t: F.contains(text, t))


def briefing_hits(units: DataFrame, sections: list[str], k: int = 24, per_file: int = 3) -> DataFrame:
    """Top units of each project for each section query, a few per file.

    The questions are a fixed list, so what each of them asks for is known when the
    plan is built, and a unit is scored for all sections in one pass over its text.
    """
    low, text = F.col("low"), F.col("text")
    static = _briefing_static()
    facts = _briefing_rows(units).select(
        *HEAD,
        static.alias("static"),
        rx.test(low, dims.CHANGELOG_FILE).alias("changelog"),
        _product_terms(text).alias("product"),
        *[rx.test(text, unit_words).alias(f"rule{i}") for i, (_, _, unit_words) in enumerate(dims.BRIEFING_RULES)],
    )

    def score(section):
        q = section_query(section).lower()
        out = F.col("static") + F.size(F.array_intersect("product", paths.strings([t for t in dims.BRIEFING_PRODUCT_TERMS if t in q]))) * 4
        if not re.search(dims.CHANGELOG_QUERY, q):
            out = out + F.when(F.col("changelog"), -55).otherwise(0)
        for i, (pts, asked, _) in enumerate(dims.BRIEFING_RULES):
            if re.search(asked, q, re.A):
                out = out + F.when(F.col(f"rule{i}"), pts).otherwise(0)
        return out

    each = F.array(*[F.struct(F.lit(s).alias("section"), score(s).alias("score")) for s in sections])
    long = facts.select(*HEAD, F.explode(each).alias("s")).select(*HEAD, "s.section", "s.score").filter("score > 0")
    few = _top(long, ["project_id", "section", "file_path"], per_file, F.desc("score")).drop("rank")
    return _top(few, ["project_id", "section"], k, F.desc("score"))


def briefing_facts(units: DataFrame) -> DataFrame:
    """What a query can ask of a unit, without its text: points, product terms, matched rules, reasons that always hold."""
    low = F.col("low")
    reasons = [
        F.when(paths.is_documentation(P), "overview documentation"),
        F.when(paths.is_package_boundary(P), "package or app boundary"),
        F.when(rx.test(low, r"^(src|app|apps|packages)/"), "production source"),
        F.when(F.col("kind") == "module", "file-level context"),
        *[
            F.when(F.contains(low, F.lit(t)) | F.contains(F.lower("name"), F.lit(t)), f"workflow term in path/name: {t}")
            for t in dims.BRIEFING_WORKFLOW_TERMS
        ],
    ]
    rows = _briefing_rows(units).withColumn("path_name", F.lower(F.concat_ws(" ", P, "name")))
    matched = [F.when(rx.test(F.col(on), words), i) for i, (_, _, on, words, _) in enumerate(dims.BRIEFING_QUERY_RULES)]
    return rows.select(
        *HEAD,
        _briefing_static().alias("static"),
        rx.test(low, dims.CHANGELOG_FILE).alias("changelog"),
        _product_terms(F.col("text")).alias("product"),
        F.array_compact(F.array(*matched)).alias("matched"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def briefing_search(units: DataFrame, queries: DataFrame) -> DataFrame:
    """The best units of a project for every query row, with the reasons of each.

    ``queries``: (query_id, project_id, query, k, per_file). What a query asks for comes down to a profile: product terms,
    rules and whether changelogs count. Units are scored once per project and profile, however many queries share it,
    and no text leaves the first step.
    """
    low = F.lower("query")
    asked = [F.when(rx.test(low, words), i) for i, (_, words, _, _, _) in enumerate(dims.BRIEFING_QUERY_RULES)]
    profile = ["project_id", "terms", "rules", "releases", "per_file"]
    rows = queries.withColumns(
        {
            "terms": _product_terms(low),
            "rules": F.array_compact(F.array(*asked)),
            "releases": rx.test(low, dims.CHANGELOG_QUERY),
        }
    ).select("query_id", *profile, "k")
    profiles = rows.groupBy(*profile).agg(F.max("k").alias("most"))
    # Product terms and rules in common; their points come from a table that is part of the row, not of the plan.
    points = F.array(*[F.lit(p) for p, *_ in dims.BRIEFING_QUERY_RULES])
    why = paths.strings([r for *_, r in dims.BRIEFING_QUERY_RULES])
    both = F.array_intersect("rules", "matched")
    score = (
        F.col("static")
        + F.size(F.array_intersect("product", "terms")) * 4
        + F.aggregate(both, F.lit(0), lambda total, i: total + F.get(points, i))
        + F.when(F.col("changelog") & ~F.col("releases"), -55).otherwise(0)
    )
    scored = profiles.join(briefing_facts(units), "project_id").withColumns(
        {"score": score, "reasons": F.concat("reasons", F.transform(both, lambda i: F.get(why, i)))}
    )
    scored = scored.filter("score > 0").select(*profile, "most", "id", P, "start_line", "score", "reasons")
    in_file = Window.partitionBy(*profile, P).orderBy(*_order(F.desc("score")))
    over = Window.partitionBy(*profile).orderBy(*_order(F.desc("score")))
    few = scored.withColumn("n", F.row_number().over(in_file)).filter("n <= per_file")
    best = few.withColumn("rank", F.row_number().over(over)).filter("rank <= most")
    return rows.join(best.drop("n", "most"), profile).filter("rank <= k").select(
        "query_id", "project_id", "id", P, "score", "rank", "reasons"
    )


# --- choosing the context of a section -------------------------------------------------------------------------


def select_context(candidates: DataFrame, units: DataFrame, budget: int) -> DataFrame:
    """Fill a section's context: overview documents first, then in candidate order.

    ``candidates``: (project_id, section, id, ord), a bounded number per section
    (planned units plus at most 24 hits). Whatever does not fit is skipped.
    """
    text = units.select("project_id", "id", "file_path", "code", "start_line", "end_line")
    ratio = F.when(F.col("section") == "Top User Workflows", 0.12).otherwise(0.18)
    rows = tokens.with_cut(
        candidates.join(text, ["project_id", "id"]),
        F.floor(F.lit(budget) * ratio).cast("int"),
        F.array().cast("array<string>"),
    ).select(
        "project_id", "section", "id", "file_path", "ord", F.col("cut_start").alias("start_line"), F.col("cut_end").alias("end_line"),
        tokens.estimate(F.col("cut_code")).alias("tokens"),
        paths.is_overview_doc(P).alias("is_overview"),
        F.array_contains(paths.evidence_buckets(P), "overview_docs").alias("in_overview"),
    )
    group = ["project_id", "section"]

    def nth(flag):
        w = Window.partitionBy(*group, flag).orderBy("ord")
        return F.col(flag) & (F.row_number().over(w) <= 2)

    tier = F.when(F.col("first_overview"), 0).when(F.col("first_bucket"), 1).otherwise(2)
    w = Window.partitionBy(*group).orderBy("tier", "ord")
    placed = (
        rows.withColumn("first_overview", nth("is_overview"))
        .withColumn("first_bucket", nth("in_overview"))
        .withColumn("tier", tier)
        .withColumn("place", F.row_number().over(w))
        .withColumn("budget", F.lit(budget))
        .select(*group, "id", "file_path", "start_line", "end_line", "tokens", "place", "budget")
    )
    out = walk(placed, group, [F.col("place")], F.col("tokens"), lambda kept, total, row: total + row["tokens"] <= row["budget"])
    return out.withColumn("slot", F.row_number().over(Window.partitionBy(*group).orderBy("place"))).drop("place", "budget")


# --- workflow units of a set of sections ------------------------------------------------------------


def section_workflow_units(requests: DataFrame, central: DataFrame, lifecycle: DataFrame, evidence: DataFrame, traces: DataFrame) -> DataFrame:
    """Planned units of every section set, in order, each unit once.

    ``requests``: (request_id, project_id, sections). The workflow section opens with the life cycle, puts workflows about
    access and assistance behind the others, and ends with central units of other files; every other set opens with
    central units. Workflows take part when the names of the sections ask for them.
    ``central`` and ``lifecycle``: (project_id, id, file_path, pos); ``evidence``: (project_id, workflow, id, file_path, rank).
    """
    joined = F.lower(F.array_join("sections", " "))
    asked = requests.select(
        "request_id",
        "project_id",
        F.array_contains("sections", "Top User Workflows").alias("top"),
        (rx.test(joined, dims.WORKFLOW_SECTION) | rx.test(joined, dims.REFILL_PRODUCT_SECTION)).alias("any_workflow"),
        rx.test(joined, dims.RISK_SECTION).alias("risky"),
    )
    buckets = paths.evidence_buckets(F.col(P))

    def touches(wanted):
        return F.bool_or(F.arrays_overlap(buckets, paths.strings(wanted)))

    # A workflow is secondary beside a life cycle when it touches access or assistance and no main class.
    kinds = evidence.groupBy("project_id", "workflow").agg(
        touches(dims.RISK_BUCKETS).alias("at_risk"),
        (touches(dims.SECONDARY_BUCKETS) & ~touches(dims.PRIMARY_BUCKETS)).alias("aside"),
    )
    living = lifecycle.select("project_id").distinct().withColumn("living", F.lit(True))
    kinds = kinds.join(living, "project_id", "left").withColumn("aside", F.col("aside") & F.coalesce("living", F.lit(False)))
    flows = (
        evidence.join(traces.select("project_id", "workflow", F.col("rank").alias("at")), ["project_id", "workflow"])
        .join(kinds.select("project_id", "workflow", "at_risk", "aside"), ["project_id", "workflow"])
        .select("project_id", "id", P, "at_risk", "aside", "at", F.col("rank").alias("place"))
    )
    aside_files = flows.filter("aside").select("project_id", P).distinct()
    beside = central.join(aside_files, ["project_id", P], "left_anti")
    beside = beside.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("pos"))).filter("n <= 6")

    def piece(tier, *order):
        places = [*order, *[F.lit(0)] * (3 - len(order))]
        return F.struct(F.lit(tier).alias("tier"), *[p.cast("long").alias(f"p{i}") for i, p in enumerate(places)])

    pieces = [
        lifecycle.select("project_id", "id", piece(0, F.col("pos")).alias("at"), F.lit("top").alias("part")),
        central.filter("pos <= 12").select("project_id", "id", piece(0, F.col("pos")).alias("at"), F.lit("other").alias("part")),
        flows.select(
            "project_id", "id", piece(1, F.col("aside").cast("int"), F.col("at"), F.col("place")).alias("at"),
            F.when(F.col("at_risk"), "flow_at_risk").otherwise("flow").alias("part"),
        ),
        beside.select("project_id", "id", piece(2, F.col("pos")).alias("at"), F.lit("top").alias("part")),
    ]
    planned = reduce(lambda a, b: a.unionByName(b), pieces)
    part = F.col("part")
    fits = (
        F.when(part == "top", F.col("top"))
        .when(part == "other", ~F.col("top"))
        .otherwise(F.col("any_workflow") | (F.col("risky") & (part == "flow_at_risk")))
    )
    rows = asked.join(planned, "project_id").filter(fits)
    # Outside the workflow section the rank alone orders the workflows.
    at = F.when(F.col("top") | (F.col("at.tier") != 1), F.col("at")).otherwise(F.col("at").withField("p0", F.lit(0).cast("long")))
    first = rows.groupBy("request_id", "project_id", "id").agg(F.min(at).alias("at"))
    order = Window.partitionBy("request_id").orderBy("at", "id")
    return first.select("request_id", "project_id", "id", F.row_number().over(order).alias("pos"))
