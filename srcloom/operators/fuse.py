"""Merging channel hits, reranking them, and the retrieval evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rules, rx
from srcloom.functions import paths, questions, unittext

PLAN_ORDER = ["exact", "overview", "grep", "lexical"]
FALLBACK_ORDER = ["exact", "grep", "lexical", "overview"]
OVERVIEW_INTENTS = ["architecture_overview", "business_overview"]


def _with_order(hits: DataFrame, order: list[str]) -> DataFrame:
    """Number hits the way the channel lists would be concatenated."""
    position = F.array_position(paths.strings(order), F.col("channel"))
    return hits.withColumn("seen", position * 100000 + F.col("rank"))


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return df.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= k)


def merge(hits: DataFrame, k: int, order: list[str] = PLAN_ORDER) -> DataFrame:
    """One row per unit: best score, best rank, first place among equals."""
    return _merge_seen(_with_order(hits, order), k)


def _merge_seen(hits: DataFrame, k: int) -> DataFrame:
    merged = hits.groupBy("query_id", "project_id", "unit_id").agg(
        F.max("score").alias("score"),
        F.min("rank").alias("keyword_rank"),
        F.bool_or("is_vendored").alias("is_vendored"),
        F.min("seen").alias("seen"),
    )
    return _top(merged, k).drop("seen")


def keep_best(hits: DataFrame, k: int, order: list[str] = PLAN_ORDER) -> DataFrame:
    """Whole record of the best score; the first one wins a tie."""
    ordered = _with_order(hits, order)
    best = F.max_by(F.struct("score", F.col("rank").alias("keyword_rank"), "is_vendored"), F.struct("score", -F.col("seen")))
    merged = ordered.groupBy("query_id", "project_id", "unit_id").agg(best.alias("b"), F.min("seen").alias("seen"))
    return _top(merged.select("query_id", "project_id", "unit_id", "b.*", "seen"), k).drop("seen")


def retrieve_by_plan(plans: DataFrame, hits: DataFrame, k: int = 2 * dims.FUSED_TOP_K) -> DataFrame:
    """Fuse the channels a plan turns on; a question left without hits gets all four."""
    flags = plans.select("query_id", "use_exact", F.col("intent").isin(OVERVIEW_INTENTS).alias("use_overview"))
    planned = (
        F.col("channel").isin("grep", "lexical")
        | ((F.col("channel") == "exact") & F.col("use_exact"))
        | ((F.col("channel") == "overview") & F.col("use_overview"))
    )
    marked = hits.join(flags, "query_id").withColumn("planned", planned)
    any_planned = F.max("planned").over(Window.partitionBy("query_id"))
    chosen = marked.withColumn("any_planned", any_planned).filter(F.col("planned") | ~F.col("any_planned"))
    position = F.when(
        F.col("any_planned"), F.array_position(paths.strings(PLAN_ORDER), F.col("channel"))
    ).otherwise(F.array_position(paths.strings(FALLBACK_ORDER), F.col("channel")))
    return _merge_seen(chosen.withColumn("seen", position * 100000 + F.col("rank")), k)


def with_features(queries: DataFrame) -> DataFrame:
    """Question columns that scoring needs, computed once per question."""
    q = F.col("query")
    return queries.withColumns(
        {
            "terms": questions.term_values(q),
            "needles": questions.short_needles(q),
            "paths": F.transform(questions.paths_in(q), F.lower),
            "low_query": F.lower(q),
            "asks_workflow": rx.test(F.lower(q), dims.WORKFLOW_QUERY),
            "asks_support": rx.test(q, dims.SUPPORT_QUERY, "i"),
            "asks_tests": rx.test(q, dims.TEST_QUERY, "i"),
        }
    )


def _stage_text() -> Column:
    return F.lower(F.concat_ws(" ", F.lower("file_path"), "name", "code"))


def with_marks(units: DataFrame) -> DataFrame:
    """Units with what the rules find in their text and path, judged once per unit, before they meet questions."""
    if "workflow_marks" in units.columns:
        return units
    # Columns of their own are made once, not once per rule.
    cols = {"path_lower": F.col("_low_path"), "stage_text": F.col("_stage")}
    low = F.col("_low_path")
    overview = [
        paths.is_documentation(F.col("file_path")),
        rx.test(low, dims.RERANK_ENTRY),
        rx.test(low, dims.RERANK_PIPELINE),
        rx.test(low, dims.CORE_SUBSYSTEM),
    ]
    return units.withColumns({"_low_path": F.lower("file_path"), "_stage": _stage_text()}).withColumns(
        {
            "workflow_marks": F.array(*[rx.test_words(cols[row[4]], cols[row[4]], row[5]) for row in dims.WORKFLOW_EVIDENCE]),
            "overview_marks": F.array(*overview),
            "is_test": paths.is_test_file(F.col("file_path")),
        }
    ).drop("_low_path", "_stage")


def with_asked(features: DataFrame) -> DataFrame:
    """Questions with the workflow rules they ask for, so that no text of theirs is needed behind."""
    asked = [rx.test(F.col("low_query"), row[3]) if row[3] else F.lit(True) for row in dims.WORKFLOW_EVIDENCE]
    return features.withColumn("asked_marks", F.array(*[F.col("asks_workflow") & a for a in asked]))


def workflow_rules(scale: str) -> list[tuple[Column, int, str]]:
    """(condition, points, reason) of the workflow evidence rules, over :func:`with_marks` and :func:`with_asked`."""
    return [
        (F.get("asked_marks", F.lit(i)) & F.get("workflow_marks", F.lit(i)), row[0] if scale == "reranker" else row[1], row[2])
        for i, row in enumerate(dims.WORKFLOW_EVIDENCE)
    ]


def overview_rules() -> list[tuple[Column, int, str]]:
    wanted = F.col("intent").isin(OVERVIEW_INTENTS)
    reasons = [
        (8, "documentation overview source"), (7, "entry point source"), (6, "central workflow source"), (3, "core subsystem source"),
    ]
    return [(wanted & F.get("overview_marks", F.lit(i)), points, reason) for i, (points, reason) in enumerate(reasons)]


def total(table: list[tuple[Column, int, str]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, _ in table])


def test_penalty(amount: int) -> Column:
    demoted = F.col("is_test") & ~F.col("asks_tests")
    return F.when(demoted, -amount).otherwise(0)


def rerank(features: DataFrame, merged: DataFrame, units: DataFrame, k: int = dims.FUSED_TOP_K) -> DataFrame:
    """Rescore the few fused hits of a question against the unit text.

    ``features`` is :func:`with_features` plus ``intent``; only the surviving hits
    meet the code text.
    """
    per_query = Window.partitionBy("query_id")
    asked = with_asked(features).select("query_id", "terms", "needles", "paths", "intent", "asks_tests", "asked_marks")
    candidates = merged.withColumn("best", F.max("score").over(per_query)).join(asked, "query_id")
    judged = with_marks(units).withColumnRenamed("id", "unit_id").drop("is_vendored")
    joined = candidates.join(judged, ["project_id", "unit_id"])
    text = unittext.rerank_text()
    head = F.lower(F.concat_ws(" ", "file_path", "name", F.array_join("exported_names", " ")))
    literal = F.exists(F.array_union("needles", "paths"), lambda n: F.contains(text, n))
    n_terms = F.size(F.filter("terms", lambda t: F.contains(head, t)))
    workflow, overview = workflow_rules("reranker"), overview_rules()
    base = F.when(F.col("best") > 0, F.col("score") / F.col("best") * 20).otherwise(0.0)
    score = base - (F.col("ord") - 1) * F.lit(0.001).cast("double")
    for part in (
        F.when(literal, 28).otherwise(0),
        F.least(F.lit(8), n_terms * 2),
        total(workflow),
        total(overview),
        test_penalty(30),
        F.when(F.col("is_vendored"), -20).otherwise(0),
    ):
        score = score + part
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("keyword rank "), F.col("keyword_rank").cast("string")),
            F.when(literal, "exact query literal/path match"),
            F.when(n_terms > 0, F.concat(n_terms.cast("string"), F.lit(" query term matches"))),
            *[F.when(c, t) for c, _, t in workflow + overview],
            F.when(test_penalty(1) < 0, "test source demoted for non-test query"),
            F.when(F.col("is_vendored"), "vendored source demoted"),
        )
    )
    scored = joined.select(
        "query_id",
        "project_id",
        "unit_id",
        "file_path",
        "name",
        "kind",
        F.col("score").alias("original_score"),
        score.alias("score"),
        "keyword_rank",
        "is_vendored",
        reasons.alias("reasons"),
        F.col("ord").alias("seen"),
    )
    return _top(scored, k).withColumnRenamed("ord", "rank").drop("seen")


def evaluate(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per case: missing expected files and whether the case passed.

    ``cases`` holds (query_id, expected array); ``ranked`` the reranked hits, at most
    ``top_k`` per case.
    """
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path"))).alias("r"))
    got = F.coalesce(F.col("r.file_path"), F.array().cast("array<string>"))
    missing = F.array_except("expected", got)
    return cases.join(lists, "query_id", "left").select(
        "query_id",
        (F.size(missing) == 0).alias("passed"),
        missing.alias("missing_files"),
        got.alias("ranked_files"),
    )
