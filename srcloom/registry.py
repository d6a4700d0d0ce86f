"""Named queries and their check SQL, filled by the modules in ``srcloom.plans``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcloom.checks import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = [
    "ingest_queries",
    "text_queries",
    "graph_queries",
    "retrieval_queries",
    "packing_queries",
    "citation_queries",
    "briefing_queries",
    "survey_queries",
    "history_queries",
    "followup_queries",
    "refill_queries",
]


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its optional check SQL."""

    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            SQL[name] = views.sql(check)
        return fn

    return keep


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"srcloom.plans.{module}")
