"""Searchable texts and size terms of a code unit, by the standard unit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths


def _list(name: str, sep: str) -> Column:
    return F.array_join(name, sep)


def _doc() -> Column:
    return F.coalesce("docstring", F.lit(""))


def search_text() -> Column:
    return F.concat_ws(
        "\n", "file_path", "kind", "name", _doc(), _list("imports", "\n"), _list("exported_names", "\n"),
        _list("called_functions", "\n"), "code",
    )


def briefing_text() -> Column:
    return F.lower(
        F.concat_ws(
            "\n", "file_path", "name", "kind", _doc(), _list("exported_names", " "), _list("called_functions", " "), "code"
        )
    )


def rerank_text() -> Column:
    return F.lower(F.concat_ws("\n", "file_path", "name", "code", _list("imports", "\n"), _list("exported_names", "\n")))


def workflow_text() -> Column:
    return F.lower(
        F.concat_ws("\n", "file_path", "name", _list("exported_names", " "), _list("called_functions", " "), "code")
    )


def length_penalty() -> Column:
    p = F.col("file_path")
    n = F.col("end_line") - F.col("start_line") + 1
    doc = paths.is_documentation(p)
    return (
        F.when(doc & rx.test(F.lower(p), dims.README_ANYWHERE), 0)
        .when(doc & (n > 1000), -30)
        .when(n > 1200, -32)
        .when(n > 600, -20)
        .when(n > 300, -8)
        .otherwise(0)
    )


def kind_priority() -> Column:
    return F.try_element_at(paths.lit_map(dims.KIND_PRIORITY), F.col("kind"))
