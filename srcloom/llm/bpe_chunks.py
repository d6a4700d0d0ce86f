"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over bytes cuts texts where the content says so, so passages that
documents share fall into the same chunks wherever they stand. Of each distinct chunk
the inside, from its first to its last anchor, is encoded and decoded once per worker.
An anchor is white space after a non-space character: both sides of it are encoded
alike with or without each other. The text between the last anchor of one chunk and the
first of the next is the join; it is repaired by encoding it anew, widened over
following chunks until it ends at an anchor, where the two encodings agree exactly.

Edge cases: a null text counts as empty (no ids, empty decoded text); a null id is kept;
texts with unusual white space have no anchors and are encoded whole; an empty table gives
an empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from srcloom.llm import bpe, common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_chunks_reused long"
#: A cut falls after every byte whose rolling hash has these bits zero: about 256 bytes apart.
CUT_MASK = np.uint32(0xFF)
WINDOW = 16
#: Distinct chunks whose encoding one worker keeps; the cache starts anew when it is full.
CACHE_CHUNKS = 100_000

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_ANCHOR = re.compile(rb"(?<=[^ \t-\r])[ \t-\r]")
_LAST_ANCHOR = re.compile(rb".*[^ \t-\r](?=[ \t-\r])", re.S)


def cut_places(data: bytes) -> list[int]:
    """Where chunks end: a sum over the last ``WINDOW`` bytes, each shifted by its age, decides."""
    x = _GEAR[np.frombuffer(data, np.uint8)]
    h = x.copy()
    width = 1
    while width < WINDOW:  # the hash of twice the width is this one and its shifted predecessor
        older = np.zeros_like(h)
        older[width:] = h[:-width] if width < len(h) else 0
        h = h + (older << np.uint32(width)) if width < len(h) else h
        width *= 2
    h ^= h >> np.uint32(15)
    return (np.flatnonzero((h & CUT_MASK) == 0) + 1).tolist()


class Codec:
    """Encodes to bytes of little-endian 32-bit ids; decodes by the library's own symbols."""

    def __init__(self, path: str):
        from srcloom.llm.token_counts import byte_letters

        self.encoder = bpe.Encoder(path)
        library = self.encoder.library
        size = library.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
        letters = byte_letters()
        self.bytes_of = [
            added[i].encode() if i in added else bytes(letters[c] for c in library.id_to_token(i) or "") for i in range(size)
        ]
        self.digits_of = [str(i) for i in range(size)]
        self.cache: dict[bytes, tuple | None] = {}

    def coded(self, part: bytes) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal, and the decoded bytes."""
        ids = self.encoder.ids(part.decode()).tolist()
        return len(ids), ",".join([self.digits_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def chunk(self, data: bytes) -> tuple | None:
        """Head, coded inside and tail of a chunk, or None if it has no two anchors."""
        first = _ANCHOR.search(data)
        if first is None:
            return None
        last = _LAST_ANCHOR.match(data).end()
        inside = data[first.start() : last]
        return data[: first.start()], self.coded(inside) if inside else None, data[last:]

    def run(self, text: str) -> tuple[int, str, bytes, int, int]:
        data = text.encode()
        if bpe.ODD.search(text):
            return (*self.coded(data), 1, 0)
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        parts, pending, start, reused = [], [], 0, 0
        ends = cut_places(data) if data else []
        if data and (not ends or ends[-1] != len(data)):
            ends.append(len(data))
        for end in ends:
            piece = data[start:end]
            start = end
            if piece in self.cache:
                reused += 1
                found = self.cache[piece]
            else:
                found = self.cache[piece] = self.chunk(piece)
            if found is None:
                pending.append(piece)
                continue
            head, inside, tail = found
            pending.append(head)
            if any(pending):
                parts.append(self.coded(b"".join(pending)))
            if inside:
                parts.append(inside)
            pending = [tail]
        if any(pending):
            parts.append(self.coded(b"".join(pending)))
        return (
            sum(p[0] for p in parts),
            ",".join([p[1] for p in parts if p[0]]),
            b"".join([p[2] for p in parts]),
            len(ends),
            reused,
        )


_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""

    def digests(texts):
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_chunks_reused")}
        for text in texts:
            n, ids, decoded, chunks, reused = codec(path).run(text)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.decode(errors="replace").encode()).hexdigest())
            out["n_chunks"].append(chunks)
            out["n_chunks_reused"].append(reused)
        return out

    return common.id_and_text(docs).mapInArrow(common.per_text(digests, SCHEMA), SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The ids themselves: ``doc_id`` and ``ids``."""
    schema = "doc_id long, ids array<int>"

    def ids(texts):
        return {"ids": [[int(i) for i in codec(path).run(t)[1].split(",") if i] for t in texts]}

    return common.id_and_text(docs).mapInArrow(common.per_text(ids, schema), schema)
