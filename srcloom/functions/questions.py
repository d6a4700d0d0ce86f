"""What a question asks for: features, intent and retrieval plan. Row-local."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions.lists import bound
from srcloom.functions.paths import strings

TERM_TYPE = "array<struct<value:string,code_like:boolean>>"


def split_identifier(text: Column) -> Column:
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+", -1), F.lower), lambda x: F.length(x) > 1)


def identifiers(q: Column) -> Column:
    found = F.concat(rx.extract_all(q, dims.Q_QUOTED, 1), rx.extract_all(q, dims.Q_BARE, 0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 2))


def paths_in(q: Column) -> Column:
    return rx.extract_all(q, dims.Q_PATH, 0)


def phrases(q: Column) -> Column:
    return F.filter(F.transform(rx.extract_all(q, dims.Q_PHRASE, 1), rx.trim), lambda x: x != "")


def constants(q: Column) -> Column:
    return rx.extract_all(q, dims.Q_CONSTANT, 0)


def needles(q: Column) -> Column:
    """Literal strings worth an exact search, in order of trust."""
    found = F.concat(
        phrases(q), paths_in(q), constants(q), rx.extract_all(q, dims.Q_DOTTED, 0), rx.extract_all(q, dims.Q_IDENT, 0)
    )
    return F.filter(F.array_distinct(found), lambda x: F.length(x) >= 3)


def short_needles(q: Column) -> Column:
    """Lower-cased phrases and constants, used when packing."""
    return F.array_distinct(F.transform(F.concat(phrases(q), constants(q)), F.lower))


def terms(q: Column, most: int | None = None) -> Column:
    """All distinct terms, or the first ``most``; a term keeps its first place and its last spelling."""
    def chosen(words: Column) -> Column:
        backwards, low = words["backwards"], words["low"]

        def describe(value):
            spelled = F.element_at(backwards, F.array_position(low, value).cast("int"))
            return F.struct(value.alias("value"), rx.test(spelled, dims.Q_CODE_LIKE).alias("code_like"))

        order = F.array_except(F.array_distinct(F.reverse(low)), strings(dims.STOP_WORDS))
        return F.transform(order if most is None else F.slice(order, 1, most), describe)

    def both(backwards: Column) -> Column:
        return F.struct(backwards.alias("backwards"), F.transform(backwards, F.lower).alias("low"))

    return bound(bound(F.reverse(rx.extract_all(q, dims.Q_TERM, 0)), both), chosen).cast(TERM_TYPE)


def term_values(q: Column) -> Column:
    return F.transform(terms(q), lambda t: t["value"])


def _mentions(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def intent(q: Column) -> Column:
    low = F.lower(rx.trim(q))
    symbol = rx.test(q, dims.QUOTED_SYMBOL) | (rx.test(q, dims.CAPITAL_SYMBOL) & rx.test(q, dims.SYMBOL_WORD, "i"))
    business = _mentions(low, dims.BUSINESS_WORDS)
    return (
        F.when(
            _mentions(low, dims.OVERVIEW_QUERY_WORDS),
            F.when(business, "business_overview").otherwise("architecture_overview"),
        )
        .when(_mentions(low, dims.RISK_WORDS), "risk_or_gap_analysis")
        .when(_mentions(low, dims.DEPENDENCY_WORDS), "dependency_explanation")
        .when(rx.test(low, dims.FILE_QUESTION), "file_explanation")
        .when(business, "business_overview")
        .when(_mentions(low, dims.ARCHITECTURE_WORDS), "architecture_overview")
        .when(_mentions(low, dims.WORKFLOW_WORDS), "workflow_trace")
        .when(symbol, "specific_symbol")
        .otherwise("general_code_question")
    )


def mode(q: Column, intent_: Column) -> Column:
    literal = (
        rx.test(q, dims.QUOTED_LITERAL)
        | rx.test(q, dims.ERROR_WORD, "i")
        | rx.test(q, dims.Q_CONSTANT)
        | rx.test(q, dims.LONG_NUMBER)
    )
    return (
        F.when(intent_.isin("file_explanation", "specific_symbol"), "exact")
        .when(literal, "literal")
        .when(intent_.isin("architecture_overview", "business_overview"), "summary_graph")
        .when(intent_.isin("workflow_trace", "dependency_explanation", "risk_or_gap_analysis"), "graph_hybrid")
        .otherwise("hybrid")
    )


def with_plan(df: DataFrame, query: str = "query") -> DataFrame:
    """Add the retrieval plan of a question: intent, mode, evidence, budgets, ratio."""
    staged = df.withColumn("intent", intent(F.col(query)))
    staged = staged.withColumn("mode", mode(F.col(query), F.col("intent")))
    i, m = F.col("intent"), F.col("mode")

    def pick(value):
        out = F.lit(None)
        for name, row in dims.PLANS.items():
            out = F.when(m == name, value(row)).otherwise(out)
        return out

    trace = (m == "graph_hybrid") & (i == "workflow_trace")
    return staged.withColumns(
        {
            "required_evidence": F.when(trace, strings(dims.WORKFLOW_TRACE_EVIDENCE)).otherwise(
                pick(lambda r: strings(r[0]))
            ),
            "preferred_sources": pick(lambda r: strings(r[1])),
            "graph_direction": pick(lambda r: F.lit(r[2])),
            "code_budget": pick(lambda r: F.lit(r[3][0])),
            "docs_budget": pick(lambda r: F.lit(r[3][1])),
            "tests_budget": pick(lambda r: F.lit(r[3][2])),
            "use_exact": m == "exact",
            "use_lexical": F.lit(True),
            "use_graph": m.isin("summary_graph", "graph_hybrid"),
            "include_summary": (m == "summary_graph")
            | ((m == "graph_hybrid") & i.isin("workflow_trace", "risk_or_gap_analysis")),
            "ratio": pick(lambda r: F.lit(r[4])),
            "reason": pick(lambda r: F.lit(r[5])),
        }
    )


def followup_intent(q: Column) -> Column:
    low = F.lower(q)
    out = None
    for name, pattern in dims.FOLLOWUP_INTENTS:
        hit = rx.test(low, pattern)
        if name == "code_explanation":
            hit = hit | rx.test(q, dims.QUOTED_LITERAL)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general_followup")


def expand_followup(q: Column, followup: Column) -> Column:
    out = q
    for name, hint in dims.FOLLOWUP_HINTS.items():
        out = F.when(followup == name, F.concat(q, F.lit(" " + hint))).otherwise(out)
    return out


def traversal(q: Column) -> Column:
    """Direction in which to follow imports for a question."""
    low = F.lower(q)
    return (
        F.when(rx.test(low, dims.DOWNSTREAM_QUERY), "downstream")
        .when(rx.test(low, dims.UPSTREAM_QUERY), "upstream")
        .otherwise("bidirectional")
    )
