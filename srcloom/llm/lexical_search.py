"""Exact ranked lexical search over bit-sliced Bloom signatures.

* **Index.** Texts of similar length (equal powers of two of entries) form blocks. A block is a matrix
  of bits: a row per signature position, a column per document. Every term sets ``HASHES``
  positions of its document, and again for each level of ``LEVELS`` that its frequency reaches.
* **Bounds.** The AND of a term's rows overestimates where it occurs (and how often). Summed with the weights
  of an item's terms, level by level, the rows give an upper bound of every document's score.
* **Exact scores.** The best bounds of every task are scored from their whole texts; the k-th best of
  these is a score that the answer reaches for certain. Every document whose bound reaches
  it is scored exactly; all others are provably outside. Equal scores are never cut off.

Items are searched in blocks of about ``ITEM_ROWS`` different (item, term) pairs, each against all documents; an item is not cut.
Signatures see 48-bit hashes, which can only raise a bound; frequencies and scores come from the terms themselves.

Edge cases: null or empty texts and texts without a term are no documents and, as items, get no row; repeated
rows of a document are documents of their own; texts of equal item id are one item, equal rows counted once; null ids are ids like
any other and sort last; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm import common

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Signature positions of an entry, and positions per entry (up to twice as many).
HASHES, BITS_PER_ENTRY = 5, 8
#: Least frequencies of the levels; a term of level l and not l + 1 occurs less often than LEVELS[l + 1].
LEVELS = (1, 2, 3, 5, 9)
#: Bits of a block, and its largest and least number of documents.
BLOCK_BITS, MOST_DOCS, FEWEST_DOCS = 1 << 23, 2048, 8
#: (item, term) pairs of one block of items.
ITEM_ROWS = 200_000
#: (term, document) cells of a block that are unpacked at a time.
CELLS = 1 << 23

INDEX = "doc_ids array<long>, n array<long>, most array<long>, positions long, bits binary"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20250107).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER))


class Terms:
    """All terms of a list of texts as 64-bit hashes, with their places in the joined bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts) + 1]
        inside = ~_SEPARATES[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.per_text = np.diff(np.searchsorted(self.starts, begins))
        self.owner = np.repeat(np.arange(len(texts)), self.per_text)
        up, down = common.powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[self.data] * up[:-1], dtype=np.uint64)])
            sizes = (self.ends - self.starts).astype(np.uint64)
            self.hashes = common.mix((total[self.ends] - total[self.starts]) * down[self.starts] + sizes)


def _term_hashes(words: list[str]) -> np.ndarray:
    return Terms([w.encode() for w in words]).hashes


def _places(hashes: np.ndarray, level: int, positions: int) -> np.ndarray:
    """Signature positions of 48-bit term hashes at a level, a row per hash function."""
    with np.errstate(over="ignore"):
        seed = hashes + np.uint64((level + 1) << 50)
        found = [common.mix(seed + np.uint64(0x632BE59BD9B4E019) * np.uint64(j + 1)) for j in range(HASHES)]
    return np.stack(found) & np.uint64(positions - 1)


# ---- index -----------------------------------------------------------------------------------


def _block(members: list) -> dict:
    positions = max(64, BITS_PER_ENTRY << max(0, max(len(m[3]) for m in members) - 1).bit_length())
    bits = np.zeros((positions, -(-len(members) // 8)), np.uint8)
    for column, (_, _, _, entries, levels) in enumerate(members):
        for level in range(len(LEVELS)):
            for rows in _places(entries[levels == level], level, positions):
                bits[rows, column >> 3] |= np.uint8(128 >> (column & 7))
    ids, n, most = ([m[i] for m in members] for i in range(3))
    return {"doc_ids": ids, "n": n, "most": most, "positions": positions, "bits": bits.tobytes()}


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, numbers of terms, highest frequencies and the bit matrix."""

    target = common.arrow_schema(INDEX)

    def run(batches):
        waiting = defaultdict(list)
        for batch in common.slices(batches):
            found = Terms([t.encode() for t in batch.column("text").to_pylist()])
            if not len(found.hashes):
                continue
            ids = batch.column("doc_id").to_pylist()
            # 16 bits of the text's number and 48 of the hash; slices hold fewer texts than that, or are cut again.
            for low in range(0, batch.num_rows, 1 << 16):
                part = (found.owner >= low) & (found.owner < low + (1 << 16))
                keys = (found.owner[part] - low).astype(np.uint64) << np.uint64(48) | found.hashes[part] >> np.uint64(16)
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                often = np.diff(np.append(first, len(keys)))
                keys = keys[first]
                cuts = np.searchsorted(keys, np.arange(min(batch.num_rows - low, 1 << 16) + 1, dtype=np.uint64) << np.uint64(48))
                if batch.num_rows - low >= 1 << 16:
                    cuts[-1] = len(keys)
                hashes = keys & np.uint64((1 << 48) - 1)
                for i in range(len(cuts) - 1):
                    span = slice(cuts[i], cuts[i + 1])
                    if cuts[i] == cuts[i + 1]:
                        continue
                    h, tf = hashes[span], often[span]
                    at_least = [tf >= least for least in LEVELS]
                    entries = np.concatenate([h[a] for a in at_least])
                    levels = np.repeat(np.arange(len(LEVELS), dtype=np.int8), [int(a.sum()) for a in at_least])
                    size = max(3, (len(entries) - 1).bit_length())
                    group = waiting[size]
                    group.append((ids[low + i], int(found.per_text[low + i]), int(tf.max()), entries, levels))
                    if len(group) >= min(MOST_DOCS, max(FEWEST_DOCS, BLOCK_BITS // (BITS_PER_ENTRY << size))):
                        yield pa.RecordBatch.from_pylist([_block(waiting.pop(size))], schema=target)
        for group in waiting.values():
            yield pa.RecordBatch.from_pylist([_block(group)], schema=target)

    return common.id_and_text(docs).mapInArrow(run, INDEX)


# ---- items -----------------------------------------------------------------------------------


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of every item."""
    rows = common.id_and_text(items, id_col, text_col).distinct()

    def run(batches):
        for batch in common.slices(batches):
            out = [
                (i, term, times)
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for term, times in Counter(terms(text)).items()
            ]
            columns = zip(*out) if out else ([], [], [])
            kinds = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "term", "times"]
            )

    pairs = rows.mapInArrow(run, "item_id long, term string, times long")
    return pairs.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Items:
    """A block of items: its different terms, and each item's terms with how often they occur in it."""

    def __init__(self, rows):
        self.words = sorted({r["term"] for r in rows})
        number = {w: i for i, w in enumerate(self.words)}
        bags = defaultdict(list)
        for r in rows:
            bags[r["item_id"]].append((number[r["term"]], r["times"]))
        self.ids = list(bags)
        self.bags = [sorted(bags[i]) for i in self.ids]
        self.hashes = _term_hashes(self.words)
        self.weights: list[int] = []
        self.documents = self.length = 0

    def weigh(self, documents: int, length: int, frequencies: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weights = [
            math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(len(self.words))
        ]

    def norm(self, n):
        """The length term of a text of ``n`` terms."""
        return 100 - 25 + (25 * n * self.documents) // self.length

    def scores(self, text: str, wanted: list[int]) -> list[int]:
        """Exact scores of one text for the items numbered ``wanted``."""
        found = terms(text)
        often = Counter(found)
        m = 12 * self.norm(len(found)) if found else 0
        part = {}
        out = []
        for item in wanted:
            score = 0
            for term, times in self.bags[item]:
                if term not in part:
                    tf = often.get(self.words[term], 0)
                    part[term] = self.weights[term] * ((1000000000 * tf) // (1000 * tf + m)) if tf else 0
                score += times * part[term]
            out.append(score)
        return out


def document_frequencies(docs: DataFrame, items: Items) -> dict[int, int]:
    """How many documents hold each term of a block of items."""
    order = np.argsort(items.hashes)
    keys = items.hashes[order]
    words = [w.encode() for w in items.words]
    flat = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes) - sizes
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two terms of the items have equal 64-bit hashes")

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            found = Terms([t.encode() for t in texts])
            at = np.minimum(np.searchsorted(keys, found.hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == found.hashes)
            if not len(hit):
                continue
            pairs, first = np.unique(found.owner[hit] * len(words) + order[at[hit]], return_index=True)
            hit, term = hit[first], pairs % len(words)
            # The hash names the term; the bytes of one occurrence per document and term decide.
            span = found.ends[hit] - found.starts[hit]
            same = span == sizes[term]
            hit, owner, term, span = hit[same], found.owner[hit[same]], term[same], span[same]
            offsets = np.cumsum(span) - span
            steps = np.arange(int(span.sum())) - np.repeat(offsets, span)
            equal = _FOLD[found.data[np.repeat(found.starts[hit], span) + steps]] == flat[np.repeat(begins[term], span) + steps]
            right = np.logical_and.reduceat(equal, offsets) if len(offsets) else np.zeros(0, bool)
            np.add.at(total, term[right], 1)
            if not same.all() or not right.all():
                wrong = set((pairs // len(words))[~same]) | set(owner[~right])
                for text in wrong:  # an equal hash of another term: this text is counted from its terms
                    np.subtract.at(total, term[right & (owner == text)], 1)
                    present = set(terms(texts[text]))
                    total += np.array([w in present for w in items.words])
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], names=["term", "df"])

    counted = common.id_and_text(docs).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}


# ---- bounds ----------------------------------------------------------------------------------


def bounds(items: Items, row: dict):
    """Upper bounds of all documents of an index block, as (first item, matrix of items x documents)."""
    positions, docs = row["positions"], len(row["doc_ids"])
    bits = np.frombuffer(row["bits"], np.uint8).reshape(positions, -1)
    n = np.array(row["n"], np.int64)
    most = np.array(row["most"], np.int64)
    m = items.norm(n)
    parts = [np.zeros(docs, np.int64)]
    for level in range(len(LEVELS)):
        tf = np.minimum(LEVELS[level + 1] - 1, most) if level + 1 < len(LEVELS) else most
        parts.append((1000000000 * tf) // (1000 * tf + 12 * m))
    gains = np.diff(np.stack(parts), axis=0)
    hashes = items.hashes >> np.uint64(16)
    start = 0
    while start < len(items.bags):
        end, cells = start, 0
        while end < len(items.bags) and (end == start or cells + len(items.bags[end]) * docs <= CELLS):
            cells += len(items.bags[end]) * docs
            end += 1
        chosen = items.bags[start:end]
        slots = np.array([t for bag in chosen for t, _ in bag])
        weights = np.array([times * items.weights[t] for bag in chosen for t, times in bag], np.float64)
        edges = np.concatenate([[0], np.cumsum([len(bag) for bag in chosen])])
        # Sums of whole numbers below 2**24 are exact in 32 bits.
        kind = np.float32 if max(weights[a:b].sum() for a, b in zip(edges, edges[1:])) < 1 << 24 else np.float64
        weights = weights.astype(kind)
        different, back = np.unique(slots, return_inverse=True)
        upper = np.zeros((len(chosen), docs), np.int64)
        present = None
        for level in range(len(LEVELS)):
            rows = _places(hashes[different], level, positions)
            found = bits[rows[0]]
            for r in rows[1:]:
                found &= bits[r]
            present = found if present is None else present & found
            if not present.any():
                break
            cells_of = np.unpackbits(present, axis=1, count=docs).astype(kind)
            for i in range(len(chosen)):
                span = slice(edges[i], edges[i + 1])
                upper[i] += gains[level] * (weights[span] @ cells_of[back[span]]).astype(np.int64)
        yield start, upper
        start = end


def _index_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _best_bounds(index: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, bound): of every task the k documents of highest bound for each item."""

    def run(batches):
        best = [(np.zeros(0, np.int64), []) for _ in items.bags]
        for row in _index_rows(batches):
            for start, upper in bounds(items, row):
                for i in np.flatnonzero(upper.max(axis=1) > 0):
                    values, ids = best[start + i]
                    if len(values) == k and upper[i].max() <= values.min():
                        continue
                    top = np.argpartition(-upper[i], k)[:k] if upper.shape[1] > k else np.arange(upper.shape[1])
                    top = top[upper[i][top] > 0]
                    values = np.concatenate([values, upper[i][top]])
                    ids = ids + [row["doc_ids"][d] for d in top]
                    keep = np.argsort(-values, kind="stable")[:k]
                    best[start + i] = values[keep], [ids[j] for j in keep]
        rows = [(i, d, int(v)) for i, (values, ids) in enumerate(best) for v, d in zip(values, ids)]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "bound"])

    found = index.mapInArrow(run, "item long, doc_id long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("place", rank).where(F.col("place") <= k).drop("place")


def _possible(index: DataFrame, items: Items, least: list[int]) -> DataFrame:
    """(item, doc_id) of all documents whose bound reaches the item's certain score."""
    floor = np.array(least, np.int64)

    def run(batches):
        for row in _index_rows(batches):
            ids = np.array([-1 if d is None else d for d in row["doc_ids"]], np.int64)
            null = np.array([d is None for d in row["doc_ids"]])
            for start, upper in bounds(items, row):
                i, d = np.nonzero(upper >= floor[start : start + len(upper), None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i + start, pa.int64()), pa.array(ids[d], mask=null[d])], names=["item", "doc_id"]
                )

    return index.mapInArrow(run, "item long, doc_id long")


def _exact(docs: DataFrame, pairs: DataFrame, items: Items) -> DataFrame:
    """(item, doc_id, score) of the documents named by ``pairs``, from their whole texts."""
    wanted = common.stage(
        pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")).withColumnRenamed("doc_id", "wanted_id"), "wanted"
    )
    rows = common.id_and_text(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", "items")

    def run(batches):
        for batch in common.slices(batches):
            out = []
            for i, text, chosen in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                out += [(item, i, score) for item, score in zip(chosen, items.scores(text, chosen)) if score > 0]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents of highest score above 0 for every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    pairs = common.stage(item_terms(items), "item-terms")
    blocks = -(-pairs.count() // ITEM_ROWS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not blocks:
        return out
    index = common.stage(build_index(docs), "signatures")
    size = index.select(
        F.expr("cast(size(n) as long)").alias("docs"), F.expr("aggregate(n, 0L, (a, x) -> a + x)").alias("terms")
    ).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    if not size["docs"]:
        return out
    for b in range(blocks):
        block = Items(pairs.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).collect())
        if not block.bags:
            continue
        block.weigh(size["docs"], size["terms"], document_frequencies(docs, block))
        seeds = _ranked(_exact(docs, _best_bounds(index, block, k).select("item", "doc_id"), block), k)
        certain = {r["item"]: r["s"] for r in seeds.where(F.col("rank") == k).select("item", F.col("score").alias("s")).collect()}
        possible = _possible(index, block, [certain.get(i, 1) for i in range(len(block.bags))])
        scored = _ranked(_exact(docs, possible, block), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "number long, item_id long")
        named = scored.join(names, F.col("item") == F.col("number"))
        out = out.union(named.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out


def oracle_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
    with rows as (select row_number() over () as r, doc_id, text from documents),
    words as (select r, doc_id, {words} as term from rows),
    often as (select r, doc_id, term, count(*) as tf from words group by all),
    docs as (select r, doc_id, sum(tf) as n from often group by all),
    size as (select count(*) as n_docs, sum(n) as n_terms from docs),
    lengths as (select r, n, 100 - 25 + (25 * n * n_docs) // n_terms as m from docs, size),
    bags as (
      select item_id, term, count(*) as times
      from (select item_id, {words} as term from (select distinct item_id, text from benchmark)) group by all),
    held as (select term, count(*) as df from often group by term),
    weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from held, size),
    scored as (
      select item_id, often.r, doc_id,
        cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from bags join weights using (term) join often using (term) join lengths on lengths.r = often.r group by all),
    ranked as (
      select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank,
        doc_id, score from scored where score > 0)
    select * from ranked where rank <= 20
    """
