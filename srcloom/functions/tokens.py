"""Token estimates and the window that keeps the useful part of a long unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom import rx

ABOVE = "// ... truncated above ...\n"
BELOW = "\n// ... truncated below ..."


def estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def with_cut(df: DataFrame, limit: Column, needles: Column) -> DataFrame:
    """Add ``cut_code``, ``cut_start`` and ``cut_end``: the unit cut to ``limit`` tokens.

    The window starts near the first needle that occurs, else near the first
    heading of a document, else at the top, and is moved back to a line start.
    Each step is a column of its own so that no text work is repeated.
    """
    code, c = F.col("code"), F.col
    kept = df.columns
    is_doc = rx.test(c("file_path"), r"\.(md|mdx)$", "i")
    heading = F.regexp_extract(code, r"(?s)\A(?:.*?\n)??(?=#[\t ]+\S)", 0)
    long = estimate(code) > limit
    hits = F.filter(F.transform(needles, lambda n: F.instr(F.lower(code), n)), lambda at: at > 0)
    steps = [
        {"_chars": F.when(long, limit * 3)},
        {"_hit": F.when(c("_chars").isNotNull(), F.coalesce(F.get(hits, 0), F.lit(0)))},
        {
            "_best": F.when(c("_hit") > 0, c("_hit"))
            .when(c("_chars").isNotNull() & is_doc & rx.test(code, r"^#\s+\S.*$", "m"), F.length(heading) + 1)
            .otherwise(0)
        },
        {
            "_raw": F.when(c("_best") == 0, 0)
            .otherwise(F.greatest(F.lit(0), c("_best") - 1 - F.floor(c("_chars") / 4)))
            .cast("int")
        },
        {"_before": F.when(c("_raw") > 0, F.substring(code, F.lit(1), c("_raw") + 1)).otherwise("")},
        # Start of the line that holds the raw offset.
        {"_from": F.length("_before") - F.length(F.substring_index("_before", "\n", -1))},
        {"_part": F.substring(code, c("_from") + 1, F.coalesce("_chars", F.length(code)))},
        {
            "_first": c("start_line") + F.size(F.split(F.substring(code, F.lit(1), c("_from")), "\n", -1)) - 1,
            "_more": c("_chars").isNotNull() & (c("_from") + c("_chars") < F.length(code)),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    cut = c("_chars").isNotNull()
    last = F.least(c("end_line"), c("_first") + F.size(F.split("_part", "\n", -1)) - 1)
    return df.select(
        *kept,
        F.concat(
            F.when(c("_from") > 0, F.lit(ABOVE)).otherwise(""), c("_part"), F.when(c("_more"), F.lit(BELOW)).otherwise("")
        ).alias("cut_code"),
        F.when(cut, c("_first")).otherwise(c("start_line")).cast("int").alias("cut_start"),
        F.when(cut, last).otherwise(c("end_line")).cast("int").alias("cut_end"),
    )
