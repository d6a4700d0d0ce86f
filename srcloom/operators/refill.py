"""Empty or weak sections of a briefing, refilled from a graph or from the evidence at hand.

A context (the units a briefing may cite, and the graph of its project) is condensed to one row of
facts: a few cited nodes per class, the first unit per evidence slot, the statement of the best overview
document. Briefings that share a context share its row. The facts are joined once, and all sections of a
briefing are spliced in its own row, so no text is exploded or gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import citing, paths, sections
from srcloom.operators import citations, followup, survey

KINDS = {name: kind for name, _, kind in dims.SECTIONS}
#: Nodes of a class that any fallback can show.
MOST_NODES = max(most for _, _, most, _, _ in dims.GRAPH_FALLBACKS)


def _cite(path: str = "file_path", start: str = "start_line", end: str = "end_line") -> Column:
    return F.concat(F.lit("["), path, F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"), F.lit("]"))


def cited_nodes(nodes: DataFrame, sources: DataFrame, context: DataFrame) -> DataFrame:
    """The first nodes of every class that have a citation in the context.

    ``nodes``: (context_id, node_id, type, label, summary, ord). A node that belongs to several classes is
    ranked in each; at most ``MOST_NODES`` of a class are kept.
    """
    found = survey.node_citations(
        sources.withColumnRenamed("context_id", "project_id"), context.withColumnRenamed("context_id", "project_id")
    ).withColumnRenamed("project_id", "context_id")
    classes = F.array_compact(
        F.array(F.lit("all"), *[F.when(F.col("type").isin(types), F.lit(c)) for c, types in dims.GRAPH_CLASSES.items()])
    )
    rows = nodes.join(found, ["context_id", "node_id"]).withColumn("class", F.explode(classes))
    place = F.row_number().over(Window.partitionBy("context_id", "class").orderBy("ord", "node_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= MOST_NODES)


def graph_facts(nodes: DataFrame, sources: DataFrame, context: DataFrame) -> DataFrame:
    """(context_id, items): cited nodes as an array of (class, rank, label, summary, citation)."""
    summary = rx.trim(F.regexp_replace("summary", r"(?i)\s+Evidence:\s+[^\n\r]*\z", ""))
    item = F.struct("class", "rank", "label", summary.alias("summary"), "citation")
    return cited_nodes(nodes, sources, context).groupBy("context_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def evidence_facts(context: DataFrame) -> DataFrame:
    """(context_id, a struct per citation group): the citations that open a context."""
    buckets = paths.evidence_buckets(F.col("file_path"))
    head = F.struct("id", _cite().alias("citation"))
    slots = [
        F.min_by(head, F.when(F.arrays_overlap(buckets, paths.strings(wanted)), F.col("ord"))).alias(slot)
        for slot, wanted in dims.EVIDENCE_SLOTS.items()
    ]
    rows = context.groupBy("context_id").agg(*slots, F.min_by(head, "ord").alias("first_unit"))

    def group(slots):
        different = F.array_distinct(F.array_compact(F.array(*slots, "first_unit")))
        return F.array_join(F.slice(different, 1, 3)["citation"], " ")

    return rows.select("context_id", *[group(s).alias(f"cite_{name}") for name, s in dims.CITED_SLOTS.items()])


def overview_facts(context: DataFrame) -> DataFrame:
    """(context_id, overview, overview_citation): the statement of the first overview document that has one."""
    units = context.withColumnRenamed("context_id", "project_id")
    said = rx.trim(rx.replace(F.col("statement"), r"\s+", " "))
    said = F.regexp_replace(said, r"[.!?]\s*\z", "")
    first = F.substring(said, 1, 1)
    ready = F.concat(F.upper(first), F.substring(said, 2, 1 << 30))
    return followup.overview_statement(units).select(
        F.col("project_id").alias("context_id"), ready.alias("overview"), F.col("citation").alias("overview_citation")
    )


def context_facts(context: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per context that holds a unit: everything a fallback text can use.

    ``context``: (context_id, id, file_path, start_line, end_line, ord, code); ``sources``: (context_id, owner_id, ord,
    file_path, start_line, end_line).
    """
    facts = evidence_facts(context).join(graph_facts(nodes, sources, context), "context_id", "left")
    return facts.join(overview_facts(context), "context_id", "left")


# --- texts of one row -----------------------------------------------------------------------------


def _of_class(name: str) -> Column:
    return F.filter("items", lambda x: x["class"] == name)


def _preferred(classes: list[str]) -> Column:
    """Items of the first of the classes that has any."""
    return reduce(lambda rest, c: F.when(F.size(_of_class(c)) > 0, _of_class(c)).otherwise(rest), reversed(classes[:-1]), _of_class(classes[-1]))


def graph_text(kind: Column) -> Column:
    """Text of a section kind from the ``items`` column; null where the graph has none."""
    primary = F.slice(_preferred(["system", "all"]), 1, 3)
    labels, cites = F.array_join(primary["label"], ", "), F.array_join(primary["citation"], " ")

    def line(form):
        def text(x, i):
            mark = F.concat((i + 1).cast("string"), F.lit(". ")) if form.startswith("#") else F.lit(form)
            return F.concat(mark, F.lit("**"), x["label"], F.lit("**: "), x["summary"], F.lit(" "), x["citation"], F.lit("."))

        return text

    out = F.lit(None).cast("string")
    for name, classes, most, form, sentence in dims.GRAPH_FALLBACKS:
        text = F.lit(None).cast("string")
        if classes:
            lines = F.transform(F.slice(_preferred(classes), 1, most), line(form))
            text = F.nullif(F.array_join(lines, "\n"), F.lit(""))
        if sentence:
            filled = F.replace(F.replace(F.lit(sentence), F.lit("{labels}"), labels), F.lit("{citations}"), cites)
            text = F.coalesce(text, filled)
        out = F.when(kind == name, text).otherwise(out)
    return F.when(F.size("items") > 0, out)


def evidence_text(section: Column, kind: Column) -> Column:
    """Text of a section from the first units and the overview document of a context."""

    def ended(text, group):
        return F.concat(text, F.lit(" "), F.col(f"cite_{group}"), F.lit("."))

    group, text = dims.OTHER_EVIDENCE_FALLBACK
    plain = ended(F.lit(text), group)
    for name, (group, text) in dims.EVIDENCE_FALLBACKS.items():
        plain = F.when(kind == name, ended(F.lit(text), group)).otherwise(plain)
    note = F.try_element_at(paths.lit_map(dims.SECTION_NOTES), section)
    overview = F.lit(None).cast("string")
    for name, before in dims.OVERVIEW_FALLBACKS.items():
        said = F.concat(F.lit(before), F.col("overview"), F.lit(" "), F.col("overview_citation"), F.lit("."))
        overview = F.when(kind == name, said).otherwise(overview)
    return F.coalesce(overview, F.when(note.isNotNull(), ended(note, "core")), plain)


def kind_of(section: Column) -> Column:
    return F.coalesce(F.try_element_at(paths.lit_map(KINDS), section), section)


_HEADING = r"^(###[ \t]+[^\n]*\n(?:\s*\n)?)"


def spliced(text: Column, wanted: Column) -> Column:
    """``text`` with the wanted sections refilled where they need it."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=###[ \t]+)", -1)
    titles = F.transform(parts, lambda c: F.lower(rx.trim(F.regexp_extract(c, r"^###[ \t]+([^\n]*)", 1))))
    # A section is the first heading of its name, whatever the case of its letters.
    names = F.transform(
        titles, lambda t, i: F.when((t != "") & (F.array_position(titles, t) == i + 1), F.get(F.filter(wanted, lambda w: F.lower(w) == t), 0))
    )

    def one(pair):
        section, part = pair["name"], pair["part"]
        kind = kind_of(section)
        body = F.regexp_replace(part, r"^[^\n]*\n?", "")
        empty = sections.needs_backfill(body, kind == "Product In One Paragraph", ~section.isin(citations.SYNTHESIS_SECTIONS))
        heading = F.regexp_extract(F.concat(part, F.lit("\n")), _HEADING, 1)
        filled = F.concat(heading, F.coalesce(graph_text(kind), evidence_text(section, kind)), F.lit("\n"))
        return F.when(section.isNotNull() & empty, filled).otherwise(part)

    pairs = F.zip_with(parts, names, lambda p, n: F.struct(p.alias("part"), n.alias("name")))
    return citing.squeeze(F.substring(F.array_join(F.transform(pairs, one), "\n"), 2, 1 << 30))


def backfill_sections(briefs: DataFrame, context: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Briefings whose empty, uncited or weak sections are refilled.

    ``briefs``: (brief_id, context_id, text, sections), where ``sections`` names those to look at. The result has the
    refilled ``text`` and ``before``; a briefing without a unit in its context stays as it is.
    """
    rows = briefs.join(context_facts(context, nodes, sources), "context_id", "left")
    known = F.col("cite_core").isNotNull()
    text = F.when(known, spliced(F.col("text"), F.col("sections"))).otherwise(F.col("text"))
    return rows.select("brief_id", "context_id", "sections", F.col("text").alias("before"), text.alias("text"))
