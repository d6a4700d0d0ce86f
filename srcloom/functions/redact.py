"""Secret redaction. Row-local, so it runs the same on batches and on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths


def _redact_assignments(line: Column, mark: str, otherwise, any_flags: str) -> Column:
    def keep_head(pattern, flags, by):
        return rx.replace(line, pattern, by, flags)

    return (
        F.when(
            rx.test(line, dims.SECRET_ASSIGNMENT, "i"),
            keep_head(dims.SECRET_ASSIGNMENT, "i", "$1" + mark),
        )
        .when(
            rx.test(rx.extract(line, dims.ANY_ASSIGNMENT, 2, any_flags), dims.SECRET_URL),
            keep_head(dims.ANY_ASSIGNMENT, any_flags, "$1" + mark),
        )
        .when(rx.test(line, dims.SECRET_JSON, "i"), keep_head(dims.SECRET_JSON, "i", "$1$2" + mark + "$3"))
        .when(
            rx.test(rx.extract(line, dims.ANY_JSON, 3), dims.SECRET_URL),
            keep_head(dims.ANY_JSON, "", "$1$2" + mark + "$4"),
        )
        .otherwise(otherwise)
    )


def redact_text(path: Column, text: Column) -> Column:
    """Remove key blocks, secret assignments and credentialed URLs from a file."""
    body = rx.replace(text, dims.PEM_BLOCK, "[REDACTED SECRET BLOCK]")

    def line_rule(line):
        # Every line rule needs an assignment sign, so most lines skip the regexes.
        may_match = F.contains(line, F.lit(":")) | F.contains(line, F.lit("="))
        return F.when(may_match, _redact_assignments(line, "[REDACTED]", line, "i")).otherwise(line)

    body = F.array_join(F.transform(F.split(body, "\r?\n", -1), line_rule), "\n")
    tokens = F.regexp_replace(body, rf"""(["'`]){dims.LONG_TOKEN}\1""", "$1[REDACTED]$1")
    first_url = F.regexp_replace(tokens, r"(?s)\A(.*?)" + rx.java(dims.SECRET_URL), "$1://[REDACTED]@")
    strict = paths.is_sensitive(path) | rx.test(paths.basename(path), dims.SECRET_NAME, "i")
    return F.when(text == "", text).when(strict, first_url).otherwise(body)


def redact_log(text: Column) -> Column:
    """Log variant: also blanks whole lines that carry credentials."""
    body = rx.replace(text, dims.LOG_PEM_BLOCK, "[redacted secret block]")

    def line_rule(line):
        low = F.lower(line)
        marked = rx.test(line, dims.SECRET_URL)
        for marker in dims.LOG_MARKERS:
            marked = marked | F.contains(low, F.lit(marker))
        rest = F.when(marked, F.lit("[redacted]")).otherwise(line)
        return _redact_assignments(line, "[redacted]", rest, "")

    # A trailing line break does not open another line.
    body = F.regexp_replace(body, "\r?\n\\z", "")
    return F.array_join(F.transform(F.split(body, "\r?\n", -1), line_rule), "\n")
