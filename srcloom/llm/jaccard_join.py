"""Near-duplicate join on word shingles with banded MinHash.

A text is the set of its runs of ``n`` words (a shorter text is one run). Texts with equal
sets are one node. Every node has ``trees`` bands of equally many MinHash values, the most at which
a pair at the threshold shares a band in at least ``recall`` of cases. This depth follows from
the parameters alone; it is not an LSH forest, whose prefixes the data shorten.
Nodes that share a band meet. Large groups are cut into blocks, and pairs
of blocks are spread over tasks; inside them the true similarity is computed from the full
sets. A pair is counted in the first tree where it meets, so no list of pairs is ever made:
a group gives each node its number of links and a star of its linked nodes, whose
connected components are the classes.

Edge cases: a null or empty text, or one without words, and rows with a null id are in no
class but their own and have no links; repeated rows count as copies; an id is expected to name one text
(rows of one id with different texts share a class); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm import common
from srcloom.llm.components import components

SCHEMA = "doc_id long, class_id long, n_links long, n_copies long"
SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.9999
#: A block of a group has about so many nodes and shingles: two blocks and their sets fit a task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19

_ODD = np.random.default_rng(99).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, from ``depth`` down, at which a pair at the threshold is met often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, first = common.word_hashes([t.encode() for t in texts])
    grams = common.gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(common.gram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray, n_hashes: int) -> np.ndarray:
    odd = _ODD[:n_hashes, None]
    low = np.full(n_hashes, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for start in range(0, len(grams), 2048):
            np.minimum(low, (grams[None, start : start + 2048] * odd).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, n: int, n_hashes: int) -> DataFrame:
    """``set_id`` (null without words), set size and signature of every text."""
    schema = "doc_id long, set_id binary, size int, signature binary"

    def run(texts):
        sets = shingle_sets(texts, n)
        return {
            "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "size": [len(s) for s in sets],
            "signature": [signature(s, n_hashes).tobytes() if len(s) else None for s in sets],
        }

    return docs.mapInArrow(common.per_text(run, schema), schema)


def prefixes(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(bucket, node, tree, size): one row per tree."""

    def run(batches):
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(ids), trees, depth)
            with np.errstate(over="ignore"):
                key = np.arange(trees, dtype=np.uint64)[None] + np.zeros((len(ids), 1), np.uint64)
                for k in range(depth):
                    key = common.mix(key * np.uint64(0x5851F42D4C957F2D) + sigs[:, :, k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64).ravel()),
                    pa.array(np.repeat(ids, trees)),
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))),
                    pa.array(np.repeat(batch.column("size").to_numpy(zero_copy_only=False), trees)),
                ],
                names=["bucket", "node", "tree", "size"],
            )

    return nodes.select("node", "signature", "size").mapInArrow(run, "bucket long, node long, tree int, size int")


def groups_of(batches, keys: list[str]):
    """Rows of equal keys, as lists of dicts, from batches sorted by the keys."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield rows


def first_meetings(rows: list[dict], trees: int, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of places in ``rows``) of the two blocks that share a prefix in this tree and in no earlier one."""
    tree, left, right = rows[0]["tree"], rows[0]["left"], rows[0]["right"]
    sigs = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows]).reshape(len(rows), trees, depth)
    block, sizes = np.array([r["block"] for r in rows]), np.array([r["size"] for r in rows])
    a_side, b_side = np.flatnonzero(block == left), np.flatnonzero(block == right)
    met = np.zeros((len(a_side), len(b_side)), bool)
    for t in range(tree):
        met |= (sigs[a_side, t][:, None] == sigs[b_side, t][None]).all(2)
    # Sizes alone rule out pairs far apart.
    least = np.minimum(sizes[a_side][:, None], sizes[b_side][None])
    wanted = ~met & (least >= threshold * np.maximum(sizes[a_side][:, None], sizes[b_side][None]) - 1e-9)
    if left == right:
        wanted &= np.tri(len(a_side), k=-1, dtype=bool)
    first, second = np.nonzero(wanted)
    return a_side[first], b_side[second]


def verify(rows: list[dict], trees: int, depth: int, threshold: float) -> list[tuple[int, int, int]]:
    """(node, least linked node, linked documents) of a pair of blocks, or of one block with itself."""
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    nodes, copies = np.array([r["node"] for r in rows]), np.array([r["copies"] for r in rows])
    pa_, pb = first_meetings(rows, trees, depth, threshold)
    different = nodes[pa_] != nodes[pb]
    pa_, pb = pa_[different], pb[different]
    if not len(pa_):
        return []
    if len(pa_) > 2 * len(rows):  # many pairs: one product of 0/1 matrices, over slices of the shingles
        every = np.unique(np.concatenate(sets))
        common_ = np.zeros((len(rows), len(rows)), np.float32)
        for start in range(0, len(every), 4096):
            part = every[start : start + 4096]
            has = np.zeros((len(rows), len(part)), np.float32)
            for k, s in enumerate(sets):
                lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], "right")
                has[k, np.searchsorted(part, s[lo:hi])] = 1
            common_ += has @ has.T
        shared = common_[pa_, pb].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(pa_, pb)])
    linked = shared >= threshold * (sizes[pa_] + sizes[pb] - shared) - 1e-9
    pa_, pb = pa_[linked], pb[linked]
    links = np.bincount(pa_, copies[pb], len(rows)) + np.bincount(pb, copies[pa_], len(rows))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(pa_.tolist(), pb.tolist()):
        i, j = find(i), find(j)
        if i != j:
            small_, large = sorted((i, j), key=lambda x: nodes[x])
            root[large] = small_
    return [(int(nodes[i]), int(nodes[find(i)]), int(links[i])) for i in np.flatnonzero(links)]


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, max_depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """Class (its least id), number of linked documents and of equal ones, for every document."""
    depth = prefix_depth(trees, max_depth, threshold, recall)
    texts = common.id_and_text(docs)
    sketched = common.stage(sketch(texts, shingle, trees * depth), "sketch")
    nodes = (
        sketched.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    )
    nodes = common.stage(nodes, "nodes")
    paths = prefixes(nodes, trees, depth)
    crowded = paths.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")).where("members > 1")
    members = common.stage(paths.drop("size").join(crowded, "bucket"), "members")

    # The full sets of the nodes that met another, from their texts.
    met = members.select("node").distinct().join(nodes, "node")

    names = ["node", "copies", "size", "signature"]

    def full_sets(batches):
        for batch in common.slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == i for s, i in zip(sets, batch.column("set_id").to_pylist())]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "grams"]
            )
            yield out.filter(pa.array(same))

    sets = texts.join(met, F.col("doc_id") == F.col("node")).select(*names, "set_id", "text")
    sets = sets.mapInArrow(full_sets, "node long, copies long, size int, signature binary, grams binary")
    sets = common.stage(sets.dropDuplicates(["node"]), "sets")

    n_blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.least(F.col("members"), F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    spread = (
        members.withColumn("n_blocks", n_blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("bucket", "tree", "node", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    )
    keys = ["bucket", "left", "right"]
    # A pair may meet in many trees, but its sets are needed only where it meets first: signatures alone tell who.
    sketches = sets.select("node", "size", "signature")
    place = ["bucket", "tree", "node", "block", "left", "right"]

    def who(batches):
        for rows in groups_of(batches, keys):
            if len(rows) > 1:
                chosen = np.unique(np.concatenate(first_meetings(rows, trees, depth, threshold)))
                if len(chosen):
                    columns = [[rows[i][c] for i in chosen] for c in place]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=place)

    gathered = spread.join(sketches, "node").repartition(*keys).sortWithinPartitions(*keys)
    needed = gathered.mapInArrow(who, "bucket long, tree int, node long, block int, left int, right int")
    meetings = needed.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        for rows in groups_of(batches, keys):
            found = verify(rows, trees, depth, threshold) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["node", "least", "links"])

    found = common.stage(meetings.mapInArrow(compare, "node long, least long, links long"), "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_set = (
        nodes.select("set_id", "node", "copies")
        .join(links, "node", "left")
        .join(classes.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left")
        .select("set_id", F.coalesce("least", "node").alias("class"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
    known = F.col("doc_id").isNotNull() & F.col("class").isNotNull()
    return sketched.select("doc_id", "set_id").join(by_set, "set_id", "left").select(
        "doc_id",
        F.when(known, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(known, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL by comparing all pairs that share a shingle."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS gram FROM d, range(1, greatest(len(ws) - 3, 2)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, s, x.n AS na, y.n AS nb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE s >= 0.8 * (x.n + y.n - s) - 1e-9),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS class_id,
  coalesce(any_value(c.links), 0) AS n_links, 1 + coalesce(any_value(c.same), 0) AS n_copies
FROM d LEFT JOIN r ON r.x = d.doc_id
LEFT JOIN (SELECT a, count(*) AS links, count(*) FILTER (s = na AND s = nb) AS same FROM l GROUP BY a) c ON c.a = d.doc_id
GROUP BY d.doc_id
"""
