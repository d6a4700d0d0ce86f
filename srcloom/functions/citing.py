"""Citations and claims inside an answer text. Row-local."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions.lists import bound

RANGE = r"^\d+(?:-\d+)?$"
WITH_FILE = r"^(.+?):(\d+(?:-\d+)?)$"
# A bracket citation must not be a link: the next character may not open a parenthesis.
_BRACKET = r"\[(" + dims.BRACKET_BODY + r")\](?!\()"


def bracket_bodies(text: Column) -> Column:
    return F.transform(rx.extract_all(text, _BRACKET, 1), rx.trim)


def bare_citations(text: Column) -> Column:
    return F.transform(rx.extract_all(text, dims.BARE_CITATION, 1), rx.trim)


def has_citation(text: Column) -> Column:
    return rx.test(text, _BRACKET) | rx.test(text, dims.BARE_CITATION)


def expand_group(body: Column) -> Column:
    """``f:1-2, 5-6, g:3`` as single citations; a bare range takes the last file."""
    parts = F.filter(F.transform(F.split(body, rx.java(r"\s*,\s*"), -1), rx.trim), lambda p: p != "")

    def step(acc, part):
        file = rx.extract(part, WITH_FILE, 1)
        inherits = acc["file"].isNotNull() & rx.test(part, RANGE)
        return F.struct(
            F.coalesce(F.nullif(file, F.lit("")), acc["file"]).alias("file"),
            F.array_append(
                acc["out"], F.when((file == "") & inherits, F.concat(acc["file"], F.lit(":"), part)).otherwise(part)
            ).alias("out"),
        )

    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<string>").alias("out"))
    several = F.aggregate(parts, start, step)["out"]
    return F.when(F.size(parts) <= 1, F.array(rx.trim(body))).otherwise(several)


def citations(text: Column) -> Column:
    """Distinct citations of an answer: bracketed ones, then bare ones not already covered."""

    def with_bare(bracketed: Column) -> Column:
        bare = F.filter(
            bare_citations(text),
            lambda c: ~F.exists(bracketed, lambda b: (b == c) | F.endswith(b, F.concat(F.lit("/"), c))),
        )
        return F.array_distinct(F.concat(bracketed, bare))

    return bound(F.flatten(F.transform(bracket_bodies(text), expand_group)), with_bare)


def normalize(value: Column) -> Column:
    return rx.replace(F.lower(value), r"\s+", "")


def parse(citation: Column) -> Column:
    """struct(path, start_line, end_line, line_only) of a citation."""
    c = rx.trim(citation)
    line_only = rx.test(c, RANGE)
    pattern = r"^(.+?)(?::(\d+)(?:-(\d+))?)?$"
    first = F.when(line_only, rx.extract(c, r"^(\d+)", 1)).otherwise(rx.extract(c, pattern, 2))
    last = F.when(line_only, rx.extract(c, r"-(\d+)$", 1)).otherwise(rx.extract(c, pattern, 3))
    start = first.try_cast("bigint")
    return F.struct(
        F.when(~line_only, normalize(rx.extract(c, pattern, 1))).alias("path"),
        start.alias("start_line"),
        F.coalesce(last.try_cast("bigint"), start).alias("end_line"),
        line_only.alias("line_only"),
    )


def normalize_claim(text: Column) -> Column:
    plain = F.regexp_replace(text, "[`*_~]", "")
    return F.lower(rx.trim(rx.replace(plain, r"\s+", " ")))


def split_claims(text: Column) -> Column:
    """Sentences of an answer that state something and should carry a citation."""
    lines = F.split(text, "\n+", -1)
    sentences = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?])[" + rx.WS + "]+", -1)))
    cleaned = F.transform(sentences, lambda x: rx.trim(rx.replace(x, r"^[-*]\s+", "")))

    def is_claim(x):
        skipped = reduce(lambda a, b: a | b, [rx.test(x, p, f) for p, f in dims.CLAIM_SKIP])
        return (F.length(x) > 40) & ~skipped

    return F.filter(cleaned, is_claim)


def checked_claims(text: Column) -> Column:
    """Claims without those that only tell the reader where to look."""
    return F.filter(split_claims(text), lambda x: ~rx.test(x, dims.NAVIGATION_CLAIM, "i"))


def section_text(text: Column, titles: list[str]) -> Column:
    """Lines below the named headings, down to the next heading."""
    wanted = [t.strip().lower() for t in titles]

    def step(acc, line):
        heading = rx.extract(line, r"^#{2,6}\s+(.*?)\s*$", 1)
        is_heading = rx.test(line, r"^#{2,6}\s+(.*?)\s*$")
        inside = F.when(is_heading, F.lower(rx.trim(heading)).isin(wanted)).otherwise(acc["inside"])
        return F.struct(
            inside.alias("inside"),
            F.when(inside & ~is_heading, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.split(text, "\n", -1), start, step)["out"], "\n")


def squeeze(text: Column) -> Column:
    return rx.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def is_list_item(line: Column) -> Column:
    return rx.test(line, dims.LIST_ITEM)
