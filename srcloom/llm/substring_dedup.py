"""Removal of repeated passages with suffix automata.

A word goes if it lies in a window of ``window`` words that also starts in a document with
a smaller id. Comparing every text with every automaton would be quadratic, so the work is
narrowed first, without loss, by keys that equal windows must share:

1. Texts equal to one with a smaller id repeat as a whole.
2. Every window has a minimizer, its least hash of ``key`` consecutive words. Only windows
   whose minimizer occurs in two different texts can repeat; the texts without any leave here.
3. The hashes of these windows give each its owner, the smallest id.
4. An owner's windows, joined to passages, are its reference shard, from which a suffix automaton
   is built. The passages of other documents that name this owner are sent to it, in salted parts
   to copies of a popular shard, and stream through the automaton. Where its matching
   statistics reach the window length, the match is removed. So what the hashes
   proposed is decided on the words.

A shard is part of one document, so an automaton's size is bound by the longest text.
It is sent to the tasks that need it, not to all: the shards together grow with the data.

Edge cases: a null text has no words; rows with a null id are left whole and remove nothing; repeated
rows get equal results and do not remove each other; of different texts under one id only one (the least
md5) is compared with others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm import common
from srcloom.llm.jaccard_join import groups_of

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WINDOW, KEY = 50, 24
#: Windows of one hash that go under one key of a join, and hashes that can be spread over more keys.
HOT_ROWS, MOST_HOT = 20_000, 10_000
#: Words that one copy of a shard is to be streamed at most (a single passage may be longer).
STREAM_WORDS = 100_000
EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def minimizers(words: np.ndarray, window: int, key: int) -> np.ndarray:
    """The minimizer of every window."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(common.gram_hashes(words, key), window - key + 1)


def each_text(batch: pa.RecordBatch):
    """(row number, word hashes) of every text of a batch."""
    words, first = common.word_hashes([t.encode() for t in batch.column("text").to_pylist()])
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        yield k, words[a:b]


class Automaton:
    """Suffix automaton over sequences of numbers."""

    def __init__(self):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0

    def add(self, sequence: list[int]) -> None:
        """Append one more sequence, starting anew at the root."""
        goto, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            step = goto[last].get(symbol)
            if step is not None and length[step] == length[last] + 1:
                last = step
                continue
            clone_only = step is not None
            if not clone_only:
                here = len(length)
                length.append(length[last] + 1)
                goto.append({})
                link.append(0)
                p = last
                while p >= 0 and symbol not in goto[p]:
                    goto[p][symbol] = here
                    p = link[p]
                if p < 0:
                    last = here
                    continue
                step = goto[p][symbol]
                if length[step] == length[p] + 1:
                    link[here] = step
                    last = here
                    continue
            else:
                here, p = -1, last
            copy = len(length)
            length.append(length[p] + 1)
            goto.append(dict(goto[step]))
            link.append(link[step])
            link[step] = copy
            while p >= 0 and goto[p].get(symbol) == step:
                goto[p][symbol] = copy
                p = link[p]
            if here >= 0:
                link[here] = copy
                last = here
            else:
                last = copy

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of the sequence that are covered by matches of at least ``least`` symbols."""
        goto, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in goto[state]:
                state = link[state]
                matched = length[state]
            step = goto[state].get(symbol)
            if step is None:
                state, matched = 0, 0
                continue
            state, matched = step, matched + 1
            if matched >= least:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1] = (min(out[-1][0], start), i + 1)
                else:
                    out.append((start, i + 1))
        return out


def survey(texts: DataFrame, window: int, key: int) -> DataFrame:
    """Per document: digest of all words, their number, and the distinct minimizers."""
    schema = "doc_id long, md5 string, n_words long, whole_sha256 string, keys array<long>"

    def run(batches):
        for batch in common.slices(batches):
            keys, counts, digests = [], [], []
            for text, (_, words) in zip(batch.column("text").to_pylist(), each_text(batch)):
                keys.append(np.unique(minimizers(words, window, key)).view(np.int64))
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(text.encode().split())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("md5"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "md5", "n_words", "whole_sha256", "keys"],
            )

    return texts.mapInArrow(run, schema)


def passages(positions: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows at the sorted positions."""
    breaks = np.flatnonzero(np.diff(positions) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(positions, breaks) if len(p)]


def with_owners(windows: DataFrame, owned: DataFrame) -> DataFrame:
    """Windows with the owner of their hash; the windows of one hot hash are spread over many keys.

    Only the ``MOST_HOT`` most frequent hashes can be spread, which bounds their table. Any other
    hash has no more windows than each of those, so at most one in ``MOST_HOT`` of all.
    """
    hot = owned.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "w").limit(MOST_HOT)
    hot = [(r["w"], -(-r["n"] // HOT_ROWS)) for r in hot.select("w", "n").collect()]
    if not hot:
        return windows.join(owned.select("w", "owner"), "w")
    copies = F.broadcast(windows.sparkSession.createDataFrame(hot, "w long, copies long"))
    salt = F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("copies", F.lit(1)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))
    spread = windows.join(copies, "w", "left").withColumn("salt", salt).drop("copies")
    return spread.join(owned.join(copies, "w", "left").select("w", "owner", salts.alias("salt")), ["w", "salt"]).drop("salt")


def shared_keys(firsts: DataFrame) -> DataFrame:
    """(first, keys): of every text the keys that another text has too; texts without any are left out.

    A row per key is shuffled, so it holds two numbers and not the digest of the text.
    """
    occurs = firsts.select("first", F.explode("keys").alias("k"))
    shared = occurs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return occurs.join(shared, "k").groupBy("first").agg(F.collect_list("k").alias("keys"))


def repeat_spans(docs: DataFrame, window: int = WINDOW, key: int = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The survey (with ``first``, the least id of its text), the candidate texts, and (doc_id, md5, spans) to remove."""
    texts = common.id_and_text(docs).withColumn("md5", F.md5(F.col("text").cast("binary")))
    found = common.stage(survey(texts, window, key), "survey")
    firsts = found.where("doc_id is not null").groupBy("md5").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    long_ = firsts.where(F.size("keys") > 0).groupBy("first").agg(F.min(F.struct("md5", "keys")).alias("x"))
    long_ = common.stage(long_.select("first", "x.md5", "x.keys"), "firsts")
    wanted = shared_keys(long_.select("first", "keys")).join(long_.select("first", "md5"), "first")
    candidates = texts.join(wanted.withColumnRenamed("first", "doc_id"), ["doc_id", "md5"])
    candidates = common.stage(candidates.select("doc_id", "md5", "text", "keys"), "candidates")

    def window_rows(batches):
        for batch in common.slices(batches):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("keys")
            hashes, owners, places = [], [], []
            for k, words in each_text(batch):
                own = keys[k].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(minimizers(words, window, key), own))
                hashes.append(common.gram_hashes(words, window)[at].view(np.int64))
                owners.append(np.full(len(at), ids[k], np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (hashes, owners, places)], names=["w", "doc_id", "at"]
            )

    windows = candidates.mapInArrow(window_rows, "w long, doc_id long, at int")
    owned = windows.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    owned = common.stage(owned.where("owner <> last").select("w", "owner", "n"), "owners")
    hits = with_owners(windows, owned).groupBy("doc_id", "owner").agg(F.sort_array(F.collect_set("at")).alias("at"))
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("owner", "at")).alias("hits"))

    def routes(batches):
        for batch in common.slices(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            all_hits = batch.column("hits").to_pylist()
            for k, words in each_text(batch):
                for hit in all_hits[k]:
                    for a, b in passages(np.array(hit["at"], np.int64), window):
                        rows.append((hit["owner"], hit["owner"] != ids[k], ids[k], a, words[a:b].tobytes()))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)],
                names=["owner", "streamed", "doc_id", "start", "words"],
            )

    routed = candidates.select("doc_id", "text").join(per_doc, "doc_id").mapInArrow(
        routes, "owner long, streamed boolean, doc_id long, start int, words binary"
    )
    routed = common.stage(routed, "passages")
    load = routed.where("streamed").groupBy("owner").agg(
        F.ceil(F.sum(F.length("words")) / (8 * STREAM_WORDS)).cast("int").alias("copies")
    )
    salt = F.when(F.col("streamed"), F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("copies")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("copies") - 1)
    )
    keys = ["owner", "salt"]
    dealt = routed.join(load, "owner").withColumn("salt", F.explode(salt)).drop("copies")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "streamed", "start")

    def match(batches):
        rows, owner, automaton = [], None, Automaton()
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["owner"], row["salt"])
                if key != owner:
                    owner, automaton = key, Automaton()
                words = np.frombuffer(row["words"], np.int64).tolist()
                if not row["streamed"]:
                    automaton.add(words)
                else:
                    rows += [(row["doc_id"], row["start"] + a, row["start"] + b) for a, b in automaton.spans(words, window)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))],
                    names=["doc_id", "start", "end"],
                )
                rows = []

    spans = dealt.mapInArrow(match, "doc_id long, start int, end int")
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    # Of the texts of one id, the spans belong to the one that was compared.
    spans = spans.join(long_.select(F.col("first").alias("doc_id"), "md5"), "doc_id")
    first_of = found.where("doc_id is not null").groupBy("md5").agg(F.min("doc_id").alias("first"))
    return found.drop("keys").join(first_of, "md5", "left"), candidates, spans


def marked(n: int, spans: list[dict]) -> np.ndarray:
    """Which of ``n`` words are removed."""
    steps = np.zeros(n + 1, np.int64)
    for s in spans:
        steps[s["start"]] += 1
        steps[s["end"]] -= 1
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, removed words and digest of the kept words of every document."""
    found, candidates, spans = repeat_spans(docs, window)

    def cut(batches):
        for batch in common.slices(batches):
            removed, digests = [], []
            for text, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                gone = marked(len(words), s)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("md5"), pa.array(removed, pa.int64()), pa.array(digests)],
                names=["doc_id", "md5", "removed", "digest"],
            )

    cuts = candidates.select("doc_id", "md5", "text").join(spans, ["doc_id", "md5"])
    cuts = cuts.mapInArrow(cut, "doc_id long, md5 string, removed long, digest string").dropDuplicates(["doc_id", "md5"])
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window)
    return found.join(cuts, ["doc_id", "md5"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("digest", "whole_sha256")).alias("kept_sha256"),
    )


_WORD = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` (each with the white space behind it); other columns stay."""
    found, _, spans = repeat_spans(docs, window)
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window)
    own_id, own_md5, own_spans = common.spare_names(docs, "_id", "_md5", "_spans")
    # The id of the row's text decides, so that repeated ids with other texts are not touched.
    plan = (
        found.join(spans, ["doc_id", "md5"], "left")
        .select(
            F.col("doc_id").alias(own_id), F.col("md5").alias(own_md5),
            F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.col("spans")).alias(own_spans),
        )
        .where(F.col(own_spans).isNotNull() & F.col(own_id).isNotNull())
        .dropDuplicates([own_id, own_md5])
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(plan, (docs["doc_id"] == F.col(own_id)) & (F.md5(text.cast("binary")) == F.col(own_md5)), "left")

    names = docs.columns

    def cut(batches):
        for batch in common.slices(batches):
            texts = []
            for t, s in zip(batch.column("text").to_pylist(), batch.column(own_spans).to_pylist()):
                if t and s:
                    words = _WORD.findall(t.encode())
                    gone = marked(len(words), s).tolist()
                    t = b"".join([w for w, g in zip(words, gone) if not g]).decode()
                texts.append(t)
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.select(*[F.col(f"`{n}`") for n in names], own_spans).mapInArrow(cut, docs.schema)


def oracle_sql() -> str:
    """The same in DuckDB SQL from all windows of 50 words."""
    return r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS g FROM d, range(1, greatest(len(ws) - 48, 1)) t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM w) WHERE owner < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, range(0, 50) s(k) GROUP BY doc_id),
x AS (SELECT d.doc_id, d.ws, coalesce(c.gone, []::BIGINT[]) AS gone FROM d LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS kept FROM x, range(1, len(ws) + 1) t(i)
      WHERE i NOT IN (SELECT unnest(gone)) GROUP BY doc_id)
SELECT x.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM x LEFT JOIN k USING (doc_id)
"""
