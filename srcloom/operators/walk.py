"""Greedy walks over the few rows of a group, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def walk(rows: DataFrame, group: list[str], order: list[Column], size: Column, fits: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows that a walk over each group keeps, one after the other in ``order``, which has no ties.

    ``fits(kept, total, row)`` tells whether a row is kept, given the rows kept so far and their summed ``size``. The rows of a
    group are one list, so it must be bounded; millions of small groups cost no more than their rows.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_place")
    row = F.struct(place, size.cast("long").alias("_size"), *[c for c in rows.columns if c not in group])
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.slice("_rows", 1, 0).alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        more = F.struct((acc["total"] + r["_size"]).alias("total"), F.concat(acc["kept"], F.array(r)).alias("kept"))
        return F.when(fits(acc["kept"], acc["total"], r), more).otherwise(acc)

    kept = F.aggregate("_rows", start, step)["kept"]
    return lists.select(*group, F.explode(kept).alias("_row")).select(*group, "_row.*").select(rows.columns)


def count_of(kept: Column, column: str, value: Column) -> Column:
    return F.size(F.filter(kept, lambda k: k[column] == value))
