"""Turn the condition lists of :mod:`srcloom.dims` into columns or check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import rx


def _one(test, cols):
    on, pattern, *flags = test
    text = cols[on.lstrip("!")]
    # Text in lower case is searched for the plain beginnings of the words first.
    hit = rx.test_words(text, text, pattern) if on == "overview_text" else rx.test(text, pattern, *flags)
    return ~hit if on.startswith("!") else hit


def holds(condition, cols: dict[str, Column]) -> Column:
    """Boolean column: any alternative whose tests all hold."""
    ands = [reduce(lambda a, b: a & b, [_one(t, cols) for t in alt]) for alt in condition]
    return reduce(lambda a, b: a | b, ands)


def points(rules, cols: dict[str, Column]) -> Column:
    """Sum of the points of every ``(points, ..., condition)`` rule that holds."""
    terms = [F.when(holds(r[-1], cols), F.lit(r[0])).otherwise(F.lit(0)) for r in rules]
    return reduce(lambda a, b: a + b, terms)


def reasons(rules, cols: dict[str, Column]) -> list[Column]:
    """One nullable reason column per ``(points, reason, condition)`` rule."""
    return [F.when(holds(r[2], cols), F.lit(r[1])) for r in rules]
