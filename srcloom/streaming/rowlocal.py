"""Row-local columns on a stream of files.

Redaction and classification look at one file at a time, so the same expressions
serve a batch and a stream, without state or watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions import paths, redact


def classify_files(files: DataFrame) -> DataFrame:
    """Redacted content and path classes of (file_path, content) rows."""
    p = F.col("file_path")
    return files.select(
        "file_path",
        redact.redact_text(p, F.col("content")).alias("content"),
        paths.evidence_buckets(p).alias("buckets"),
        paths.is_test_file(p).alias("is_test"),
        paths.is_documentation(p).alias("is_documentation"),
    )
