"""Lists and values that are dear to make are made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value made once, also where lambdas of the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, keep: list, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per item of ``items``, which is made once; items are not null.

    A plain explode has its list made a second time, for the filter that Spark puts before it to drop empty lists.
    """
    if pos:
        return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
