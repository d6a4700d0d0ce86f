"""Lexical retrieval of code units for many questions at once.

A question and a unit meet only when some string of the question really occurs in
the unit. The strings of a project come to the text of its units in groups, each with
the questions that ask for it, so a string is looked for once per unit however many
questions share it, strings of other projects never meet a unit, and what leaves the
text is one small row per string that does occur. Questions and units are dealt out by
project once; scores are summed and ranked where they arise, so no pair is shuffled.
A question belongs to one project.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rules, rx
from srcloom.functions import questions, unittext
from srcloom.functions.lists import rows_of

CHANNELS = ["exact", "overview", "grep", "lexical"]


def question_strings(queries: DataFrame) -> DataFrame:
    """One row per (question, role, string) with its number of occurrences, dealt out by project.

    Besides the strings of a question these are the identifier parts of its terms, the whole question (a path may lie inside
    it), and for a question about configuration and tests the empty string, which occurs in every unit.
    """
    q, found_terms = F.col("query"), F.col("found_terms")
    none = F.lit(False)

    def role(name, items):
        return F.transform(
            items, lambda s: F.struct(F.lit(name).alias("role"), s.alias("s"), none.alias("code_like"))
        )

    term = F.transform(
        found_terms, lambda t: F.struct(F.lit("term").alias("role"), t["value"].alias("s"), t["code_like"])
    )
    part = F.flatten(
        F.transform(
            found_terms,
            lambda t: F.transform(
                questions.split_identifier(t["value"]),
                lambda s: F.struct(F.lit("part").alias("role"), s.alias("s"), t["code_like"].alias("code_like")),
            ),
        )
    )
    everything = F.concat(
        role("path", F.transform(questions.paths_in(q), F.lower)),
        role("ident", F.transform(questions.identifiers(q), F.lower)),
        role("needle", questions.needles(q)),
        role("phrase", F.transform(questions.phrases(q), F.lower)),
        term,
        part,
        role("whole", F.array(F.lower(q))),
        role("support", F.when(_wants_support(q), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))),
    )
    lists = queries.withColumn("found_terms", questions.terms(q)).select("query_id", "project_id", everything.alias("xs"))
    return (
        rows_of(lists.repartition("project_id"), ["query_id", "project_id"], F.col("xs"), "x")
        .groupBy("query_id", "project_id", F.col("x.role").alias("role"), F.col("x.s").alias("s"), F.col("x.code_like").alias("code_like"))
        .agg(F.count("*").alias("n"))
    )


#: Distinct strings that meet a unit's text together, and questions that share one entry of a string.
STRINGS_PER_READ = 256
QUESTIONS_PER_STRING = 64


#: Roles that are looked for in the whole text of a unit; the others only in its path, name, exports and their parts.
IN_TEXT = ("term", "needle", "phrase", "support")


def string_groups(strings: DataFrame) -> DataFrame:
    """(project_id, strings): the strings of a project in groups, each string with the questions that ask for it.

    Both lists are bounded; a string of more questions, and a project of more strings, takes further entries and groups.
    """
    use = F.struct("query_id", "role", "code_like", "n")
    deep = F.exists("uses", lambda u: u["role"].isin(*IN_TEXT))
    nth_use = F.row_number().over(Window.partitionBy("project_id", "s").orderBy("query_id", "role", "code_like"))
    entries = (
        strings.withColumn("part", F.floor((nth_use - 1) / QUESTIONS_PER_STRING))
        .groupBy("project_id", "s", "part")
        .agg(F.collect_list(use).alias("uses"))
    )
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("s", "part"))
    return (
        entries.withColumn("block", F.floor((nth - 1) / STRINGS_PER_READ))
        .groupBy("project_id", "block")
        .agg(F.collect_list(F.struct("s", F.lower("s").alias("low"), deep.alias("deep"), "uses")).alias("strings"))
        .drop("block")
    )


def evidence(strings: DataFrame, units: DataFrame) -> DataFrame:
    """How each string of a project occurs in each of its units, as flags: a row per question and role of a string that does.

    ``strings``: (query_id, project_id, role, s, code_like, n). Only the plain columns of a unit are shuffled; its lower-case
    forms are made behind the join, once per unit and group. A string also meets a unit whose path lies inside the string.
    """
    text = unittext.search_text()
    lower = lambda items: F.transform(items, F.lower)
    forms = F.struct(
        F.lower("name").alias("name"), F.lower("file_path").alias("path"), F.lower("code").alias("code"), F.lower("docstring").alias("doc"),
        lower("exported_names").alias("exports"), lower("imports").alias("imports"), lower("called_functions").alias("calls"),
        text.alias("raw"), F.lower(text).alias("text"),
        F.array_union(questions.split_identifier(F.col("name")), questions.split_identifier(F.col("file_path"))).alias("parts"),
        F.concat_ws("\n", F.lower("file_path"), F.lower("name"), lower("exported_names")).alias("head"),
    )
    c = F.col

    def flags(x: Column, u: Column) -> Column:
        s, low = x["s"], x["low"]

        def within(items: Column, needle: Column) -> Column:
            return F.exists(items, lambda i: F.contains(i, needle))

        found = {
            "name_raw": c("name") == s,
            "name_eq": u["name"] == low,
            "name_in": F.contains(u["name"], low),
            "path_end": F.endswith(u["path"], low) | (c("file_path") == s),
            "path_in": F.contains(u["path"], low),
            "export_raw": F.array_contains("exported_names", s),
            "export_eq": F.array_contains(u["exports"], low),
            "export_in": within(u["exports"], low),
            "import_raw": within(c("imports"), s),
            "import_in": within(u["imports"], low),
            "call_in": within(u["calls"], low),
            "doc_in": F.coalesce(F.contains(u["doc"], low), F.lit(False)),
            "code_raw": F.contains("code", s),
            "code_in": F.contains(u["code"], low),
            "text_raw": F.contains(u["raw"], s),
            "text_in": F.contains(u["text"], low),
            "part_eq": F.array_contains(u["parts"], s),
            "path_inside": F.contains(low, u["path"]),
        }
        return F.struct(s.alias("s"), x["uses"].alias("uses"), *[v.alias(k) for k, v in found.items()])

    def occurs(x: Column, u: Column) -> Column:
        # Lower case of a part may differ from that part of the lower-case text, but only beyond ASCII.
        beyond = F.octet_length(x["s"]) != F.length(x["s"])
        in_text = F.contains(u["text"], x["low"]) | (beyond & F.contains(u["raw"], x["s"]))
        in_head = F.contains(u["head"], x["low"]) | F.array_contains(u["parts"], x["s"])
        return F.when(x["deep"], in_text).otherwise(in_head) | F.contains(x["low"], u["path"])

    facts = ["project_id", "id", "file_path", "start_line", "is_vendored", "support"]
    read = with_support(units).select(
        *facts, "name", "kind", "docstring", "exported_names", "imports", "called_functions", "code"
    )
    met = read.join(string_groups(strings), "project_id")
    # The one item of the outer list binds the forms of a unit; as columns of a projection they would be made once per string.
    hits = F.flatten(
        F.transform(F.array(forms), lambda u: F.transform(F.filter("strings", lambda x: occurs(x, u)), lambda x: flags(x, u)))
    )
    each = rows_of(met, facts, hits, "e").select(*facts, "e.*")
    return each.withColumn("use", F.explode("uses")).select("*", "use.*").drop("use", "uses")


def support_points() -> Column:
    """Points of a unit for questions about configuration and tests."""
    return F.when(rx.test(F.col("file_path"), dims.SUPPORT_PATH, "i"), 8).otherwise(0) + F.when(
        rx.test_words(F.col("code"), F.lower("code"), dims.SUPPORT_CODE, "i"), 8
    ).otherwise(0)


def with_support(units: DataFrame) -> DataFrame:
    return units if "support" in units.columns else units.withColumn("support", support_points())


def _damped(score: Column) -> Column:
    return F.when(F.col("is_vendored"), score * dims.VENDORED_FACTOR).otherwise(score.cast("double"))


def _points(*cases) -> Column:
    """First case that holds gives the points."""
    out = None
    for cond, pts in cases:
        out = F.when(cond, pts) if out is None else out.when(cond, pts)
    return out.otherwise(0)


def _paths_inside_questions(queries: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, project_id, id): the whole path of the unit occurs in the question."""
    whole = question_strings(queries).filter("role = 'whole'")
    return evidence(whole, units).filter("path_inside").select("query_id", "project_id", "id")


def channel_scores(queries: DataFrame, units: DataFrame) -> DataFrame:
    """Raw exact, grep and lexical scores of every (question, unit) with evidence, and what their ranking needs."""
    m = evidence(question_strings(queries), units)
    role, code_like, n = F.col("role"), F.col("code_like"), F.col("n")
    c = F.col
    constant = rx.test(c("s"), dims.Q_CONSTANT)
    either = F.when(code_like, 1).otherwise(0) == 1

    def pick(strong, weak):
        return F.when(either, strong).otherwise(weak)

    path_grep = _points((c("path_end"), 30), (c("path_in"), 15))
    path_lex = _points((c("path_end"), 18), (c("path_in"), 9))
    needle = (
        _points((c("path_end"), 28))
        + _points((c("name_raw"), 24), (c("name_eq"), 20))
        + _points((c("export_raw"), 18))
        + _points((c("import_raw"), 14))
        + _points((c("code_raw"), F.when(constant, 26).otherwise(18)), (c("code_in"), F.when(constant, 18).otherwise(10)))
        + _points((c("text_raw"), F.when(constant, 12).otherwise(6)), (c("text_in"), F.when(constant, 8).otherwise(3)))
    )
    term_grep = _points((c("name_eq"), 10)) + _points((c("path_in"), pick(8, 3)))
    term_lex = (
        _points((c("name_eq"), 10), (c("name_in"), 6))
        + _points((c("path_in"), pick(10, 5)))
        + _points((c("export_in"), pick(10, 4)))
        + _points((c("import_in"), pick(8, 4)))
        + _points((c("call_in"), pick(8, 3)))
        + _points((c("doc_in"), 3))
        + _points((c("code_in"), pick(14, 1)))
    )
    grep = (
        F.when(role == "path", path_grep * n)
        .when(role == "needle", needle)
        .when(role == "term", term_grep)
        .when(role == "part", F.when(c("part_eq"), pick(6, 2) * n).otherwise(0))
        .when(role == "support", c("support"))
    )
    lexical = (
        F.when(role == "path", path_lex * n)
        .when(role == "phrase", F.when(c("text_in"), 14).otherwise(0) * n)
        .when(role == "term", term_lex)
    )
    flags = {
        "x_path_end": (role == "path") & c("path_end"),
        "x_path_in": (role == "path") & c("path_in"),
        "x_name_eq": (role == "ident") & c("name_eq"),
        "x_name_in": (role == "ident") & c("name_in"),
        "x_export": (role == "ident") & c("export_eq"),
        "x_inside": (role == "whole") & c("path_inside"),
    }
    facts = ["query_id", "project_id", "id", "file_path", "start_line", "is_vendored"]
    rows = m.select(
        *facts, grep.otherwise(0).alias("grep"), lexical.otherwise(0).alias("lexical"), *[v.alias(k) for k, v in flags.items()]
    ).filter(reduce(lambda a, b: a | b, [c(f) for f in flags], (c("grep") > 0) | (c("lexical") > 0)))
    total = rows.groupBy(*facts).agg(
        F.sum("grep").alias("grep"), F.sum("lexical").alias("lexical"), *[F.bool_or(f).alias(f) for f in flags]
    )
    exact = (
        _points((c("x_path_end"), 20), (c("x_path_in"), 12))
        + _points((c("x_name_eq"), 18), (c("x_name_in"), 8))
        + _points((c("x_export"), 10))
        + _points((c("x_inside"), 10))
    )
    return total.select(*facts, exact.alias("exact"), "grep", "lexical")


def _wants_support(query: Column) -> Column:
    return rx.test(query, dims.GREP_SUPPORT_QUERY, "i")


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("project_id", "query_id").orderBy(F.desc("score"), "file_path", "start_line", "id")
    return (
        scored.filter("score > 0")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "project_id", F.col("id").alias("unit_id"), "channel", "score", "rank", "is_vendored")
    )


def with_overview(units: DataFrame) -> DataFrame:
    """Units with their points for overview questions, and those that questions about sales add."""
    if "overview_base" in units.columns:
        return units
    low = F.lower("file_path")
    cols = {
        "path_lower": low,
        "overview_text": F.concat_ws(" ", low, F.lower("name"), F.col("_low_code")),
    }
    sales = rx.test_words(F.col("_low_code"), F.col("_low_code"), dims.SALES_CODE)
    return units.withColumn("_low_code", F.lower("code")).withColumns(
        {"overview_base": rules.points(dims.OVERVIEW_CHANNEL, cols), "sales_bonus": F.when(sales, 8).otherwise(0)}
    ).drop("_low_code")


def overview_channel(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Overview hits. The score depends on the question only through one flag, so
    each project is ranked twice and the rankings are handed to its questions."""
    facts = with_overview(units).select(
        "project_id", "id", "file_path", "start_line", "is_vendored", F.col("overview_base").alias("base"), F.col("sales_bonus").alias("bonus")
    )
    both = facts.withColumn("sales", F.explode(F.array(F.lit(False), F.lit(True))))
    score = _damped(F.col("base") + F.when(F.col("sales"), F.col("bonus")).otherwise(0))
    w = Window.partitionBy("project_id", "sales").orderBy(F.desc("score"), "file_path", "start_line", "id")
    ranked = (
        both.withColumn("score", score)
        .filter("score > 0")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("project_id", "sales", F.col("id").alias("unit_id"), "score", "rank", "is_vendored")
    )
    asked = queries.select("query_id", "project_id", F.contains(F.lower("query"), F.lit("sales")).alias("sales"))
    return asked.join(ranked, ["project_id", "sales"]).select(
        "query_id", "project_id", "unit_id", F.lit("overview").alias("channel"), "score", "rank", "is_vendored"
    )


def with_channel(scores: DataFrame, channel: str) -> DataFrame:
    value = F.col("exact").cast("double") if channel == "exact" else _damped(F.col(channel))
    return scores.withColumns({"score": value, "channel": F.lit(channel)})


def channel_hits(queries: DataFrame, units: DataFrame, channel: str, k: int) -> DataFrame:
    """Top ``k`` units of one channel for every question."""
    if channel == "overview":
        return overview_channel(queries, units, k)
    return _rank(with_channel(channel_scores(queries, units), channel), k)


def all_channels(queries: DataFrame, units: DataFrame, ks: dict[str, int]) -> DataFrame:
    """Hits of all four channels; the text channels share one scoring pass."""
    scored = channel_scores(queries, units)
    per_channel = F.array(
        F.struct(F.lit("exact").alias("channel"), F.col("exact").cast("double").alias("score"), F.lit(ks["exact"]).alias("k")),
        F.struct(F.lit("grep").alias("channel"), _damped(F.col("grep")).alias("score"), F.lit(ks["grep"]).alias("k")),
        F.struct(F.lit("lexical").alias("channel"), _damped(F.col("lexical")).alias("score"), F.lit(ks["lexical"]).alias("k")),
    )
    long = scored.select(
        "query_id", "project_id", "id", "file_path", "start_line", "is_vendored", F.explode(per_channel).alias("c")
    ).select("*", "c.channel", "c.score", "c.k").filter("score > 0")
    w = Window.partitionBy("project_id", "query_id", "channel").orderBy(F.desc("score"), "file_path", "start_line", "id")
    ranked = (
        long.withColumn("rank", F.row_number().over(w))
        .filter((F.col("rank") <= max(ks.values())) & (F.col("rank") <= F.col("k")))
        .select("query_id", "project_id", F.col("id").alias("unit_id"), "channel", "score", "rank", "is_vendored")
    )
    return ranked.unionByName(overview_channel(queries, units, ks["overview"]))
