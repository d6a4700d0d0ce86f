"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens that a worker has not met yet are laid end to end as one ragged array of
symbols. In every round each pre-token finds its own pair of lowest rank, all of these
pairs are merged at the same time, and pre-tokens without a mergeable pair leave. The
symbols that survive are the tokens. Counts are kept per chunk (see ``bpe``), so a
repeated word costs one lookup.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); a null id is kept; special
strings in a text are one token each, as the library reads them; an empty table gives an
empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from srcloom.llm import bpe, common

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Chunks whose counts one worker keeps; the cache starts anew when it is full.
CACHE_ENTRIES = 1_000_000
#: Symbols merged in one ragged array.
BLOCK_SYMBOLS = 1 << 20

_LAST = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Merge table of a byte-level BPE file, and counting of pre-tokens with it."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, into = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs)))
        order = np.argsort(left << 20 | right)
        self.pairs, self.rank, self.into = (left << 20 | right)[order], order.astype(np.int64), into[order]
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table, or -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of every pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        counts = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        keep = lengths[owner] > 1
        symbols, owner = symbols[keep], owner[keep]
        at = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            at[:-1] = np.where(owner[:-1] == owner[1:], self.look_up(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            rank = np.where(at >= 0, self.rank[at], _LAST)
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(symbols)))
            done = best == _LAST
            if done.any():
                counts[owner[begins[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbols, owner, at, rank = symbols[stay], owner[stay], at[stay], rank[stay]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of overlapping equal pairs, as in "aaa", every other one from the left is merged.
            run = np.cumsum(np.concatenate([[True], np.diff(hit) != 1])) - 1
            run_start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            hit = hit[(np.arange(len(hit)) - run_start[run]) % 2 == 0]
            symbols[hit] = self.into[at[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            touched = np.zeros(len(symbols), bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            symbols, owner, at, touched = symbols[~gone], owner[~gone], at[~gone], touched[~gone]
            redo = np.flatnonzero(touched)
            last = redo == len(symbols) - 1
            following = np.where(last, redo, redo + 1)
            same = ~last & (owner[redo] == owner[following])
            at[redo] = np.where(same, self.look_up(symbols[redo], symbols[following]), -1)
        return counts

    def parts_of(self, chunk: str) -> tuple[int, list[str]]:
        """Special strings in a chunk, and the pre-tokens of the rest."""
        if self.split_special is None or not self.split_special.search(chunk):
            return 0, self.words.findall(chunk)
        rest = self.split_special.split(chunk)
        return len(rest) - 1, [t for part in rest for t in self.words.findall(part)]

    def count_new(self, chunks: list[str]) -> None:
        """Fill the cache for chunks that it lacks."""
        white = " \t\n\r\x0b\x0c"
        # A chunk of white space and then others may stand behind such a chunk without any change to either.
        plain = [c for c in chunks if c[0] in white and c[-1] not in white and "<" not in c and not bpe.ODD.search(c)]
        tokens = self.words.findall("".join(plain))
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        token_ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        member = np.searchsorted(ends, token_ends)
        totals = np.zeros(len(chunks), np.int64)
        names = list(plain)
        known = set(plain)
        extra, owners = [], []
        for chunk in chunks:
            if chunk not in known:
                special, parts = self.parts_of(chunk)
                totals[len(names)] = special
                extra += parts
                owners += [len(names)] * len(parts)
                names.append(chunk)
        tokens = [t.encode() for t in tokens + extra]
        member = np.concatenate([member, np.array(owners, np.int64)])
        sizes = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        start = 0
        while start < len(tokens):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BLOCK_SYMBOLS)))
            np.add.at(totals, member[start:end], self.count(tokens[start:end]))
            start = end
        self.cache.update(zip(names, totals.tolist()))

    def count_texts(self, texts: list[str]) -> list[int]:
        split = [[t] if bpe.ODD.search(t) else bpe.CHUNK.findall(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = [c for c in set().union(*split) if c and c not in self.cache]
        if new:
            self.count_new(new)
        get = self.cache.get
        out = [sum([get(c, 0) for c in chunks]) for chunks in split]
        for c in new:
            if len(c) > 64:
                del self.cache[c]
        return out


_made: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _made:
        _made[path] = Merger(path)
    return _made[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, and whether the tokens exceed ``limit``."""

    def counts(texts):
        n = merger(path).count_texts(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.id_and_text(docs).mapInArrow(common.per_text(counts, SCHEMA), SCHEMA)
