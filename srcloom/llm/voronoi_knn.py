"""Exact top-k inner products by a Voronoi join.

Every vector gets one more component that brings all data to the same length, and
queries are scaled to that length too; then the largest inner products are the smallest
distances. Data is grouped by its nearest pivot, and inside a cell cut into rings by its
distance to the pivot. Per cell, the smallest distances to the pivot give each query an
upper bound of the distance of its k-th neighbour, which also bounds its k-th score from below.
Neighbouring rings are put into bins of bounded size, and a query is sent, alone and once per bin, only to the bins
with a ring in which the triangle inequality leaves room for a neighbour. A bin keeps its data while
its queries pass by in blocks; each ring is solved by one exact matrix product with the queries that reach it, and
the best of all bins are merged.

Large rings are dealt over several bins by counts, so a hot cell is spread. Pivots are a sample whose number grows with the
root of the number of vectors, up to ``MOST_PIVOTS``; any pivots give exact results. Bounds are
floating-point numbers with slack, scores are exact integers. Whole numbers travel in the fewest bytes that hold them all.

Edge cases: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; of several rows with one id the least vector counts; of vectors
of different lengths the shorter is filled with zeros; equal scores go to the smaller id; an
empty table gives an empty table; scores outside the range of a long are cut to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from srcloom.llm import common

SCHEMA = "query_id long, rank int, vec_id long, score long"
PIVOTS, MOST_PIVOTS = 48, 1024
DATA_BLOCK = 2048
QUERY_BLOCK = 1024
MAX_RINGS = 32
#: Most blocks and bytes of a bin, the bins that small data is spread over, and vectors that make a ring of its own.
SHARE_BLOCKS, BIN_BYTES, LEAST_BINS, RING_ROWS = 128, 32 << 20, 64, 4 * DATA_BLOCK
#: Bounds of a block of queries that are worked out at once.
BOUNDS = 4 << 20
_LOCAL = "query_id long, vec_id long, score long"
#: Rows of a bin: data (kind 0, ``d`` is the distance to the pivot), then queries (kind 1, ``d`` is the reach).
_MET = "bin int, kind int, cell int, ring int, vec_id long, d double, row binary"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of every component, for vectors that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & fine)
        .select("vec_id", F.transform("x", lambda c: floor(c * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def floor(x: Column) -> Column:
    """Floor as a double, also beyond the range of a long."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


class Space:
    """Distances on the sphere whose radius is the longest data vector."""

    def __init__(self, pivots: np.ndarray, radius2: float):
        self.radius2, self.width = max(radius2, 1.0), pivots.shape[1]
        self.pivots = self.lift(pivots)
        self.slack = 1e-6 * np.sqrt(self.radius2)

    def lift(self, data: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.radius2 - (data * data).sum(1)))
        return np.concatenate([data, rest[:, None]], 1)

    def aim(self, queries: np.ndarray) -> np.ndarray:
        norms = np.sqrt((queries * queries).sum(1))
        scaled = queries * (np.sqrt(self.radius2) / np.where(norms > 0, norms, 1))[:, None]
        return np.concatenate([scaled, np.zeros((len(queries), 1))], 1)

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, square))


def exact_products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ data.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in queries], object) @ np.array([[int(c) for c in r] for r in data], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, own: np.ndarray, lower: np.ndarray, k: int):
        self.own, self.least, self.k = own, lower.copy(), k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), lower[:0]

    def add(self, near: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries ``near`` (places in the block) with the vectors ``ids``."""
        over = scores >= self.least[near][:, None]
        if scores.shape[1] > self.k and np.count_nonzero(over) > 4 * (self.k + 1) * len(near):
            # One of the k + 1 best may be the query itself.
            at = scores.shape[1] - self.k - 1
            self.least[near] = np.maximum(self.least[near], np.partition(scores, at, axis=1)[:, at])
            over = scores >= self.least[near][:, None]
        r, c = np.nonzero(over)
        row, found = near[r], ids[c]
        other = found != self.own[row]
        if not other.any():
            return
        row = np.concatenate([self.row, row[other]])
        found = np.concatenate([self.id, found[other]])
        score = np.concatenate([self.score, scores[r[other], c[other]]])
        # Falling scores: a negated long could overflow, the complement cannot.
        order = np.lexsort((found, -score if score.dtype.kind == "f" else ~score, row))
        row, found, score = row[order], found[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        full = place == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full])
        kept = place < self.k
        self.row, self.id, self.score = row[kept], found[kept], score[kept]


class Rings:
    """Rings of the cells from their counts and spans of distances, and the bins of their blocks."""

    def __init__(self, n_cells: int, cells: list):
        self.rings, self.low, self.span = np.ones(n_cells, np.int64), np.zeros(n_cells), np.ones(n_cells)
        for r in cells:
            self.rings[r["cell"]] = min(MAX_RINGS, -(-r["n"] // RING_ROWS))
            self.low[r["cell"]], self.span[r["cell"]] = r["low"], max(r["high"] - r["low"], 1e-9)

    def of(self, cell, d: np.ndarray) -> np.ndarray:
        at = np.floor((d - self.low[cell]) / self.span[cell] * self.rings[cell])
        return np.clip(at, 0, self.rings[cell] - 1).astype(np.int32)

    def fill_bins(self, rows: list, bin_rows: int) -> None:
        """Blocks of rings, one ring after the other, into bins of about ``bin_rows`` vectors."""
        rows = sorted(rows, key=lambda r: (r["cell"], r["ring"]))
        n = np.array([r["n"] for r in rows], np.int64)
        blocks = -(-n // min(DATA_BLOCK, bin_rows))
        first = np.concatenate([[0], np.cumsum(blocks)])
        size = np.repeat(n / blocks, blocks)
        self.bins = ((np.cumsum(size) - size) // bin_rows).astype(np.int32)
        self.n_bins = int(self.bins[-1]) + 1
        self.deals, self.start = np.zeros((2, len(self.rings), MAX_RINGS), np.int64)
        at = [r["cell"] for r in rows], [r["ring"] for r in rows]
        self.deals[at], self.start[at] = blocks, first[:-1]
        self.cell, self.near, self.far = np.array(at[0]), np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
        # Every ring once per bin that holds blocks of it, bin after bin.
        pairs = np.unique(np.stack([self.bins, np.repeat(np.arange(len(rows)), blocks)], 1), axis=0)
        self.held, self.begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(self.n_bins))
        self.used = np.unique(pairs[:, 0])
        self.begin = self.begin[self.used]

    def bin_of(self, cell: np.ndarray, ring: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.bins[self.start[cell, ring] + dealt(ids, self.deals[cell, ring])]


def dealt(ids: np.ndarray, deals: np.ndarray) -> np.ndarray:
    return (common.mix(ids.astype(np.int64).view(np.uint64)) % np.maximum(deals, 1).astype(np.uint64)).astype(np.int32)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as one binary value each."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


class Bins:
    """How the rows of a bin are read."""

    def __init__(self, space: Space, width: int, most: float):
        self.space, self.width = space, width
        self.exact, self.cut = most**2 * width < 2**53, most**2 * width >= 2**63
        self.kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"

    def numbers(self, rows: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(rows.to_pylist()), self.kind).reshape(len(rows), self.width)

    def lower(self, queries: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """A score that the k-th best of a query reaches at least."""
        if not self.exact:
            return np.full(len(queries), -(2**63), np.int64)
        radius, norms = np.sqrt(self.space.radius2), np.sqrt((queries * queries).sum(1))
        finite = np.where(np.isfinite(reach), reach, 0)
        bound = (self.space.radius2 - finite * finite / 2) * norms / radius - 1e-6 * radius * norms - 1
        return np.where(np.isfinite(reach), bound, -np.inf)

    def blocks(self, batches):
        """Per block of queries of a bin: ids, vectors, lower bounds of their scores, and (places of queries, ids, vectors) of the data they may meet."""
        at, data, rings = None, [], None
        for batch in batches:
            bins, kinds = batch.column("bin").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((bins[1:] != bins[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(bins)]):
                if start == end:
                    continue
                if bins[start] != at:
                    at, data, rings = bins[start], [], None
                part = batch.slice(start, end - start)
                cell, ring, ids, d = (part.column(c).to_numpy() for c in ("cell", "ring", "vec_id", "d"))
                rows = self.numbers(part.column("row"))
                if kinds[start] == 0:
                    data.append((cell, ring, ids, d, rows))
                    continue
                if rings is None:
                    rings, data = list(ring_blocks(data)), []
                for begin in range(0, len(ids), QUERY_BLOCK):
                    queries, reach = rows[begin : begin + QUERY_BLOCK].astype(float), d[begin : begin + QUERY_BLOCK]
                    distances = self.space.to_pivots(self.space.aim(queries))
                    found = []
                    for c, low, high, vec_ids, vectors in rings:
                        near = np.flatnonzero((distances[:, c] - reach <= high) & (distances[:, c] + reach >= low))
                        if len(near):
                            found.append((near, vec_ids, vectors))
                    yield ids[begin : begin + QUERY_BLOCK], queries, self.lower(queries, reach), found


def met_rows(bins, kind: int, cell, ring, ids, d, rows: pa.Array) -> pa.RecordBatch:
    columns = [
        pa.array(bins, pa.int32()), pa.array(np.full(len(bins), kind, np.int32)), pa.array(cell, pa.int32()), pa.array(ring, pa.int32()),
        pa.array(ids, pa.int64()), pa.array(d, pa.float64()), rows,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bin", "kind", "cell", "ring", "vec_id", "d", "row"])


def ring_blocks(parts: list):
    """(cell, least and largest distance, ids, vectors) of the blocks of a bin, from parts sorted by cell and ring."""
    if not parts:
        return
    cell, ring, ids, d, rows = (np.concatenate(x) for x in zip(*parts))
    edges = np.flatnonzero((cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1])) + 1
    for start, end in zip([0, *edges], [*edges, len(cell)]):
        for a in range(start, end, DATA_BLOCK):
            z = min(end, a + DATA_BLOCK)
            yield cell[a], d[a:z].min(), d[a:z].max(), ids[a:z], rows[a:z]


def meet(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, pivots: int | None) -> tuple[DataFrame | None, Bins | None]:
    """Data and queries side by side in bins, and how they are read."""
    data = common.stage(whole_vectors(vectors, id_col, vector_col), "vectors")
    facts = data.agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("radius2"), F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"),
    ).first()
    if not facts["n"]:
        return None, None
    width = max(1, facts["width"])
    pivots = pivots or int(np.clip(int(facts["n"] ** 0.5), PIVOTS, MOST_PIVOTS))
    # A bounded sample, spread by a hash; equal vectors would make equal cells.
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).select("v").collect()
    distinct = np.unique(matrix([r["v"] for r in sample], width), axis=0)
    space = Space(distinct[:: max(1, len(distinct) // pivots)][:pivots], facts["radius2"])
    read = Bins(space, width, facts["most"])
    kind = read.kind

    def assign(batches):
        for batch in common.slices(batches):
            rows = matrix(batch.column("v").to_pylist(), width)
            distances = space.to_pivots(space.lift(rows))
            cell = distances.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array(cell, pa.int32()),
                    pa.array(distances[np.arange(len(cell)), cell], pa.float64()), packed(rows.astype(kind)),
                ],
                names=["vec_id", "cell", "d", "row"],
            )

    placed = common.stage(data.mapInArrow(assign, "vec_id long, cell int, d double, row binary"), "cells")
    # Per cell: how many, and the k + 1 smallest distances to the pivot (one may be the query's own).
    span = F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")
    cells = placed.groupBy("cell").agg(*span).collect()
    close = (
        placed.select("cell", "d", "vec_id")
        .withColumn("place", F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("d")))
        .where(F.col("place") <= k + 1)
        .withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("d")))
        .where(F.col("place") <= k + 1)
        .select("cell", "d")
        .collect()
    )
    near = sorted((r["cell"], r["d"]) for r in close)
    near_cell, near_d = np.array([c for c, _ in near]), np.array([d for _, d in near])
    rings = Rings(len(space.pivots), cells)

    def ring_rows(batches):
        for batch in batches:
            ring = rings.of(batch.column("cell").to_numpy(), batch.column("d").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], names=[*batch.schema.names, "ring"])

    first = placed.select("cell", "d").mapInArrow(ring_rows, "cell int, d double, ring int")
    bin_rows = max(1, min(SHARE_BLOCKS * DATA_BLOCK, BIN_BYTES // (width * np.dtype(kind).itemsize), -(-facts["n"] // LEAST_BINS)))
    rings.fill_bins(first.groupBy("cell", "ring").agg(*span).collect(), bin_rows)

    def put(batches):
        for batch in batches:
            cell, d, ids = (batch.column(c).to_numpy() for c in ("cell", "d", "vec_id"))
            ring = rings.of(cell, d)
            yield met_rows(rings.bin_of(cell, ring, ids), 0, cell, ring, ids, d, batch.column("row"))

    def ask(batches):
        step = max(1, min(QUERY_BLOCK, BOUNDS // max(len(near_cell), len(rings.held))))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                ids, rows = batch.column("vec_id").to_numpy()[start : start + step], read.numbers(batch.column("row").slice(start, step))
                whole = rows.astype(float)
                distances = space.to_pivots(space.aim(whole))
                upper = distances[:, near_cell] + near_d[None]
                reach = np.full(len(ids), np.inf) if upper.shape[1] <= k else np.partition(upper, k, axis=1)[:, k]
                # Nothing can be left out for a zero query, nor where cut scores may be equal.
                reach = np.where((rows != 0).any(1) & (not read.cut), reach, np.inf) + space.slack
                to = distances[:, rings.cell]
                room = (to - reach[:, None] <= rings.far) & (to + reach[:, None] >= rings.near)
                q, b = np.nonzero(np.logical_or.reduceat(room[:, rings.held], rings.begin, axis=1))
                none = np.zeros(len(q), np.int32)
                yield met_rows(rings.used[b], 1, none, none, ids[q], reach[q], packed(rows[q]))

    asked = placed.where(is_query).select("vec_id", "row").mapInArrow(ask, _MET)
    met = placed.mapInArrow(put, _MET).unionByName(asked).repartition(rings.n_bins, "bin")
    return met.sortWithinPartitions("bin", "kind", "cell", "ring"), read


def candidate_blocks(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, pivots: int | None) -> tuple[DataFrame, int]:
    """The ids of blocks of data beside those of the queries that are solved with them, and the width of the vectors."""
    met, read = meet(vectors, is_query, k, id_col, vector_col, pivots)
    if met is None:
        return None, 0

    def ids_of(batches):
        for own, _, _, found in read.blocks(batches):
            for near, ids, _ in found:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, own[near])], names=["ids", "q_ids"])

    return met.mapInArrow(ids_of, "ids binary, q_ids binary"), read.width


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """The ``k`` best of all other vectors for every query."""
    met, read = meet(vectors, is_query, k, id_col, vector_col, pivots)
    if met is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)

    def solve(batches):
        for own, queries, lower, found in read.blocks(batches):
            best = Best(own, lower, k)
            for near, ids, vectors in found:
                whole = vectors.astype(float)
                best.add(near, ids, queries[near] @ whole.T if read.exact else exact_products(queries[near], whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score.astype(np.int64), pa.int64())],
                names=["query_id", "vec_id", "score"],
            )

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.mapInArrow(solve, _LOCAL).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql() -> str:
    """The same in DuckDB SQL over ``embeddings``, with every 50th id as a query and k = 5."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
