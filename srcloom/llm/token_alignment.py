"""Alignment of two tokenizers by pointer jumping.

Tokenizer A is a byte-level BPE, B a sentencepiece model; both cover the bytes of a space and the text. Every token points to the token
of the other kind that overlaps it and reaches farthest to the right; a token that ends where the other ends is
terminal. Doubling the pointers (``next = next[next]``) for all tokens at once ends, after as many
rounds as the binary digits of the longest chain, with every token at the terminal token of its component.
Components are the groups; links are the pairs of overlapping tokens, one for each stretch between
neighbouring token ends.

Texts are cut before a single space between non-space characters, where neither tokenizer joins anything (B's pieces are
checked for that when it is loaded), and each part of text is encoded once per worker and cache. Documents are dealt to blocks of about
``BLOCK_CHARS``. A block lists its different parts of text once, with their links as numbers of its different id pairs;
documents refer to them. Corpus counts are summed over the blocks' pairs, joined back to the blocks, and summed up
there, so no link becomes a row and no table is broadcast.

Edge cases: null and empty texts, and texts whose joined A or B bytes differ from space and text (a U+2581, say), have no
tokens: zeros and an empty ``groups_sha256``; repeated rows and null ids are kept and counted as they come; a very long text is a block of
its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm import bpe, common
from srcloom.llm.token_counts import byte_letters

#: Code points of text after which a block ends with the batch at hand.
BLOCK_CHARS = 8 << 20
#: Parts of text whose alignment one worker keeps; the cache starts anew with a block when it is full.
CACHE_ENTRIES = 200_000
#: Code points of parts that are encoded as one text.
JOINED_CHARS = 1 << 16
WHITE = " \t\n\r\x0b\x0c"
#: A cut before a single space that stands between other characters than white space.
CUT = re.compile(r"(?<=[^ \t-\r]) (?=[^ \t-\r])")

SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
STAGED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts binary, "
    "pair_keys array<long>, pair_counts array<long>, link_ends array<int>, link_pairs array<int>"
)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of all A and all B tokens, given their rising byte ends over the same bytes, and the rounds it took."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a)  # the B token that holds A's last byte
    to_a = np.searchsorted(ends_a, ends_b)
    nodes_b = np.arange(n, n + len(ends_b))
    succ = np.concatenate([to_b + n, np.where(ends_a[to_a] > ends_b, to_a, nodes_b)])
    rounds = 0
    while True:
        jumped = succ[succ]
        rounds += 1
        if np.array_equal(jumped, succ):
            break
        succ = jumped
    terminals, group = np.unique(succ, return_inverse=True)
    return group[:n], group[n:], rounds


def link_places(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and the B token of every overlapping pair, from left to right."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Both tokenizers and the alignments of the parts of text met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.ranks = bpe.encoder(path_a).ranks
        self.plain_a = bpe.Encoder(path_a).library
        self.plain_a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_a = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.width_a, self.width_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # Every id as text with the sign that may follow it: A's with a comma or a bar, B's with a comma or a semicolon.
        self.shown = np.array(
            [f"{i}{sign}" for x, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for sign in signs for i in range(len(x))], object
        )
        # Cuts are safe where no piece of B goes on over a space.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.names: list[str] = []  # groups as text, each ended by a semicolon
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; -1 where the bytes differ
        self.first_link = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)  # id pairs as a << 32 | b

    def ids_a(self, text: str) -> np.ndarray:
        if self.ranks is None or not bpe._PLAIN(text):
            return np.array(self.plain_a.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.ranks.encode_ordinary(text), np.int64)

    def split(self, text: str) -> list[str]:
        """Parts of space + text that can be encoded alone; every part begins with a space."""
        if not self.cuts or "▁" in text or bpe.ODD.search(text):
            return [" " + text]
        return [" " + part for part in CUT.split(text)]

    def align(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the parts of each text; empty where the text has no tokens."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.known
        out = [[known[p] for p in parts] for parts in split]
        if (self.sizes[:, 0] < 0).any():
            differs = set(np.flatnonzero(self.sizes[:, 0] < 0).tolist())
            for i, numbers in enumerate(out):
                if not differs.isdisjoint(numbers):
                    # One part differs: the bytes of the whole text decide.
                    whole = " " + texts[i]
                    self.learn({whole})
                    out[i] = [known[whole]] if self.sizes[known[whole], 0] >= 0 else []
        return out

    def learn(self, parts: set[str]) -> None:
        """Align all parts not known yet. Parts that may stand side by side are encoded as one text."""
        new = [p for p in parts if p not in self.known]
        side_by_side, alone = [], []
        for part in new:
            safe = self.cuts and len(part) > 1 and part[1] not in WHITE and part[-1] not in WHITE
            (side_by_side if safe and "▁" not in part and not bpe.ODD.search(part) else alone).append(part)
        start = 0
        while start < len(side_by_side):
            end, size = start, 0
            while end < len(side_by_side) and size < JOINED_CHARS:
                size += len(side_by_side[end])
                end += 1
            self._learn_joined(side_by_side[start:end])
            start = end
        for part in alone:
            self._learn_joined([part])

    def _learn_joined(self, parts: list[str]) -> None:
        text = "".join(parts)
        a, b = self.ids_a(text), np.array(self.b.encode(text[1:]), np.int64)
        data = text.encode()
        same = all(b"".join(map(x.__getitem__, i.tolist())) == data for x, i in ((self.bytes_a, a), (self.bytes_b, b)))
        if not same:
            if len(parts) > 1:
                for part in parts:
                    self._learn_joined([part])
                return
            self._add(parts, [""], np.full((1, 4), -1), np.zeros(1, np.int64), np.zeros(0, np.int64))
            return
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        group_a, group_b, _ = components(ends_a, ends_b)
        link_a, link_b = link_places(ends_a, ends_b)
        # Bytes equal characters in number unless some are beyond ASCII.
        widths = map(len, parts) if len(data) == len(text) else (len(p.encode()) for p in parts)
        ends = np.cumsum(np.fromiter(widths, np.int64, len(parts)))
        ends_link = np.minimum(ends_a[link_a], ends_b[link_b])
        stops = [np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, ends_link)]
        stops.insert(2, group_a[stops[0] - 1] + 1)
        counts = np.stack([np.diff(x, prepend=0) for x in stops], axis=1)
        self._add(parts, self._names(a, b, group_a, group_b, stops), counts, stops[3] - counts[:, 3], a[link_a] << 32 | b[link_b])

    def _names(self, a, b, group_a, group_b, stops) -> list[str]:
        """The groups of every part as text: of each group its A ids, then its B ids."""
        n_groups = int(group_a[-1]) + 1
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
        up_to_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + before_b[group_a]] = a + np.where(last_a, len(self.bytes_a), 0)
        code[np.arange(len(b)) + up_to_a[group_b]] = 2 * len(self.bytes_a) + b + np.where(last_b, len(self.bytes_b), 0)
        signs = self.shown[code].tolist()
        ends = (stops[0] + stops[1]).tolist()
        return ["".join(signs[s:e]) for s, e in zip([0, *ends], ends)]

    def _add(self, parts, names, counts, first_link, links) -> None:
        self.known.update(zip(parts, range(len(self.names), len(self.names) + len(parts))))
        self.names += names
        self.sizes = np.concatenate([self.sizes, counts])
        self.first_link = np.concatenate([self.first_link, first_link + len(self.links)])
        self.links = np.concatenate([self.links, links])


_made: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Aligner(path_a, path_b)
    return _made[path_a, path_b]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class _Block:
    """Documents of one block."""

    def __init__(self):
        self.rows, self.numbers, self.size = [], [], 0

    def add(self, doc_id, text: str, numbers: list[int], tool: Aligner) -> None:
        digest = hashlib.sha256("".join(map(tool.names.__getitem__, numbers))[:-1].encode()).hexdigest() if numbers else ""
        self.rows.append((doc_id, digest))
        self.numbers.append(np.array(numbers, np.int32))
        self.size += len(text)

    def batches(self, block: int, tool: Aligner, target: pa.Schema):
        """The block's own row, then its documents; parts are numbered from the most frequent."""
        lengths = np.fromiter(map(len, self.numbers), np.int64, len(self.numbers))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(self.numbers)
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(tool.sizes[flat], axis=0)])
        totals = totals[edges[1:]] - totals[edges[:-1]]
        times = np.bincount(flat, minlength=len(tool.names))
        order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
        local = np.zeros(len(tool.names), np.uint32)
        local[order] = np.arange(len(order), dtype=np.uint32)
        per_part = tool.sizes[order, 3]
        keys, places = np.unique(tool.links[_spread(tool.first_link[order], per_part)], return_inverse=True)
        counts = np.bincount(places, np.repeat(times[order], per_part), len(keys)).astype(np.int64)
        head = {"block": block, "pair_keys": keys, "pair_counts": counts}
        head |= {"link_ends": np.cumsum(per_part).astype(np.int32), "link_pairs": places.astype(np.int32)}
        yield pa.RecordBatch.from_pylist([head], schema=target)
        flat = local[flat]
        for start in range(0, len(self.rows), 1000):
            rows = []
            for i in range(start, min(start + 1000, len(self.rows))):
                doc_id, digest = self.rows[i]
                row = dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals[i].tolist()))
                # Only sums over the parts are wanted, so they are kept in order, as differences.
                steps = np.diff(np.sort(flat[edges[i] : edges[i + 1]]), prepend=np.uint32(0))
                rows.append(row | {"block": block, "doc_id": doc_id, "groups_sha256": digest, "parts": zlib.compress(steps.tobytes(), 1)})
            yield pa.RecordBatch.from_pylist(rows, schema=target)


def align_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their counts and parts, and a row per block with its id pairs."""
    target = common.arrow_schema(STAGED)

    def run(batches):
        tool = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in common.slices(batches):
            if not block.rows and len(tool.names) > CACHE_ENTRIES:
                tool.clear()
            texts = batch.column("text").to_pylist()
            for doc_id, text, numbers in zip(batch.column("doc_id").to_pylist(), texts, tool.align(texts)):
                block.add(doc_id, text, numbers, tool)
            if block.size >= BLOCK_CHARS:
                yield from block.batches(number, tool, target)
                number, block = number + 1, _Block()
        if block.rows:
            yield from block.batches(number, tool, target)

    return common.id_and_text(docs).mapInArrow(run, STAGED)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens, groups and links, the links that are their B id's most frequent, and the sum of their counts."""
    staged = common.stage(align_blocks(docs, path_a, path_b), "aligned")
    heads = staged.where("pair_keys is not null")
    pairs = heads.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pair_keys", "pair_counts")).alias("place", "p"))
    pairs = pairs.select("of", "place", F.col("p.pair_keys").alias("pair"), F.col("p.pair_counts").alias("n"))
    corpus = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.expr("pair & 4294967295")))
    corpus = corpus.select(F.col("pair").alias("key"), "count", (F.col("count") == most).alias("best"))
    counted = pairs.join(corpus, F.col("pair") == F.col("key")).select("of", "place", "count", "best")
    target = common.arrow_schema(SCHEMA)

    def finish(left, right):
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        is_head = left.column("pair_keys").is_valid()
        head, rows = left.filter(is_head).to_pylist(), left.filter(pa.compute.invert(is_head))
        ends = np.array(head[0]["link_ends"], np.int64)
        links = np.array(head[0]["link_pairs"], np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[np.concatenate([[0], ends])]) for v in (count, best)]
        steps = [np.frombuffer(zlib.decompress(p), np.uint32) for p in rows.column("parts").to_pylist()]
        flat = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in steps])
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, steps), np.int64, len(steps)))])
        total, bests = (np.diff(np.concatenate([[0], np.cumsum(s[flat])])[edges]) for s in sums)
        columns = {n: rows.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([columns[f.name] for f in target], schema=target)

    blocks = staged.groupBy("block").cogroup(counted.groupBy("of"))
    return blocks.applyInArrow(finish, SCHEMA)
