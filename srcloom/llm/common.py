"""Helpers that the operators of this subpackage share.

Every operator selects its id and text column first, so further columns of the input,
whatever their names, never reach its plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom import staging

#: White space that ends a word: space and U+0009 to U+000D.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as a long and ``text`` with null as empty; nothing else."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def id_remainder(column, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor costs nothing."""
    path = f"{staging.shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none much exceeds ``max_bytes``, unless one row does."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a DDL string; needs a session, so call it on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def per_text(function: Callable[[list[str]], dict[str, list]], schema: str) -> Callable:
    """A ``mapInArrow`` function: ``doc_id`` and the columns that ``function`` makes of the texts."""
    target = arrow_schema(schema)

    def run(batches):
        for batch in slices(batches):
            columns = {"doc_id": batch.column("doc_id"), **function(batch.column("text").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa_array(columns[f.name], f.type) for f in target], schema=target)

    return run


def pa_array(values, kind) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


# ---- words as numbers ------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, and where each text's words start (one more entry at the end).

    The bytes of all texts are hashed at once: a running sum of weighted bytes gives
    every word's polynomial as a difference.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts) + 1]
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])
