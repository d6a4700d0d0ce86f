"""Document log-likelihood under a gated recurrent language model.

Symbols are the words known from training, one symbol for all others, and the end of a text
(the same space as the unigram base). The output is factored by class: the end, one class per
range of counts for rare words (inside it, words in proportion to their counts), and classes
of equally many frequent words, each with its own softmax. The network sees frequent words
one by one and rare words as their range.

1. Texts become blocks: word hashes as indices into the block's distinct hashes.
2. Counts of all training words are summed per hash range and sent back to the blocks
   that hold the word; no table of all words is ever in one place.
3. Training: truncated backpropagation through time in numpy, states carried from window to
   window. A start on at most ``WARM_BLOCKS * WARM_TOKENS`` tokens makes the common ground; then every block
   trains its own copy on all its training texts, so every training text is learned from whatever the
   layout, and the copies are averaged, weighted by tokens, in two steps of a shuffle.
   A training token is shown with its count less one, as it would be seen were it held out,
   which also teaches the probability of unknown words.
4. Scoring: many texts run side by side in lanes, the state carried through whole texts.

Edge cases: a null text counts as empty (only the end is scored); a null id is kept and counts as the
empty text in the split; without training texts all words are unknown and scores stay
finite; an empty table gives an empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.llm import common

SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
FREQUENT, CLASS_WORDS = 2025, 45
#: Lower ends of the count ranges of rare words; the first holds unknown words alone.
RANGES = np.array([0, 1, 2, 3, 5, 9, 17, 33, 65, 129])
HIDDEN = 32
BLOCK_TOKENS = 1 << 20
SHARD_ENTRIES = 500_000
#: Blocks, tokens of each and updates of the common start.
WARM_BLOCKS, WARM_TOKENS, WARM_UPDATES = 3, 50_000, 240
LANES, STEPS = 512, 16
#: Adagrad rate of the one pass of a block; the start uses ``train``'s default.
PASS_RATE = 0.15
N_CLASSES = 1 + len(RANGES) + FREQUENT // CLASS_WORDS


# ---- blocks and counts -----------------------------------------------------------------------


def to_planes(numbers: np.ndarray) -> bytes:
    """Small numbers byte by byte, all first bytes together, and so on: this compresses well."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def to_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of up to ``BLOCK_TOKENS`` tokens: the texts as indices into ``known``."""
    schema = (
        "block string, ids array<long>, held array<boolean>, lengths array<int>, words binary, "
        "known binary, counts binary, by_frequency binary"
    )

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, hashes, size = [], [], [], [], 0

        def block():
            nonlocal number
            every = np.concatenate(hashes)
            distinct, index, seen = np.unique(every, return_inverse=True, return_counts=True)
            training = np.repeat(~np.array(held), lengths)
            counts = np.bincount(index[training], minlength=len(distinct)).astype(np.int64)
            # The texts use the place by frequency, so that most numbers are small.
            order = np.argsort(-seen, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            index = place[index]
            number += 1
            row = [f"{part}-{number}", ids, held, lengths, to_planes(index), distinct.tobytes(), counts.tobytes(), to_planes(order)]
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=target)

        names = [c.split()[0] for c in schema.split(", ")]
        target = pa.schema(
            [("block", pa.string()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32()))]
            + [(n, pa.binary()) for n in names[4:]]
        )
        for batch in common.slices(batches):
            found, first = common.word_hashes([t.encode().lower() for t in batch.column("text").to_pylist()])
            for k, (doc_id, out) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist())):
                words = found[first[k] : first[k + 1]]
                if ids and size + len(words) > BLOCK_TOKENS:
                    yield block()
                    ids, held, lengths, hashes, size = [], [], [], [], 0
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                hashes.append(words)
                size += len(words) + 1
        if ids:
            yield block()

    flagged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    return flagged.mapInArrow(run, schema)


def shard_edges(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


def count_words(blocks: DataFrame) -> DataFrame:
    """Per block and hash range the total training counts of the block's words, and per range its statistics.

    ``kind`` is ``block`` (``data``: counts in the order of the block's words) or ``stats``
    (``data``: most frequent words, sums of the count ranges, tokens and distinct words).
    """
    entries = blocks.agg(F.sum(F.length("known") / 8)).first()[0] or 0
    shards = max(1, -(-int(entries) // SHARD_ENTRIES))
    edges = shard_edges(shards)

    def split(batches):
        for batch in batches:
            for block, known, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "known", "counts"))):
                words, counts = np.frombuffer(known, np.uint64), np.frombuffer(counts, np.int64)
                at = np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])
                keep = [s for s in range(shards) if at[s + 1] > at[s]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keep, pa.int32()), pa.array([block] * len(keep), pa.string()),
                        pa.array([words[at[s] : at[s + 1]].tobytes() for s in keep], pa.binary()),
                        pa.array([counts[at[s] : at[s + 1]].tobytes() for s in keep], pa.binary()),
                    ],
                    names=["shard", "block", "words", "counts"],
                )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(w, np.uint64) for w in pdf["words"]])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in pdf["counts"]])
        distinct, index = np.unique(words, return_inverse=True)
        totals = np.bincount(index, counts, len(distinct)).astype(np.int64)
        sizes = np.cumsum([len(w) // 8 for w in pdf["words"]])[:-1]
        top = np.argsort(-totals, kind="stable")[:FREQUENT]
        ranges = np.searchsorted(RANGES, totals, "right") - 1
        stats = (
            distinct[top], totals[top], np.bincount(ranges, totals + 0.5, len(RANGES)), int(totals.sum()), int((totals > 0).sum()),
        )
        parts = np.split(totals[index], sizes)
        return pd.DataFrame(
            {
                "kind": ["block"] * len(parts) + ["stats"], "block": [*pdf["block"], ""], "shard": int(pdf["shard"].iloc[0]),
                "data": [p.tobytes() for p in parts] + [pickle.dumps(stats)],
            }
        )

    dealt = blocks.select("block", "known", "counts").mapInArrow(split, "shard int, block string, words binary, counts binary")
    return dealt.groupBy("shard").applyInPandas(total, "kind string, block string, shard int, data binary")


class Lexicon:
    """Symbols of the network, from the statistics of all hash ranges."""

    def __init__(self, counted: DataFrame, n_train_docs: int):
        def rows(batches):
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    words, counts, _, _, _ = pickle.loads(data)
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        def sums(batches):
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    _, _, by_range, tokens, distinct = pickle.loads(data)
                    yield pa.RecordBatch.from_pylist([{"by_range": by_range.tolist(), "tokens": tokens, "distinct": distinct}])

        stats = counted.where("kind = 'stats'").select("data")
        top = stats.mapInArrow(rows, "word long, n long").where("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
        summed = stats.mapInArrow(sums, "by_range array<double>, tokens long, distinct long").agg(
            F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"),
            *[F.sum(F.get("by_range", F.lit(k))).alias(f"r{k}") for k in range(len(RANGES))],
        ).first()
        words, counts = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
        order = np.argsort(words)
        self.words, self.rank = words[order], order
        self.range_sums = np.array([summed[f"r{k}"] or 0.0 for k in range(len(RANGES))])
        taken = np.bincount(np.searchsorted(RANGES, counts, "right") - 1, counts + 0.5, len(RANGES)) if len(counts) else 0.0
        self.range_sums = np.maximum(self.range_sums - taken, 1e-9)
        self.ends = n_train_docs
        self.tokens = (summed["tokens"] or 0) + n_train_docs
        self.distinct = (summed["distinct"] or 0) + (n_train_docs > 0)
        self.top_counts = counts

    def frequent(self, words: np.ndarray) -> np.ndarray:
        """Rank among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.rank[at], -1)

    def symbols(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of every word (0 end, then count ranges, then frequent words) and log10 of its share of a range."""
        rank = self.frequent(words)
        ranges = np.searchsorted(RANGES, counts, "right") - 1
        share = np.log10((counts + 0.5) / np.maximum(self.range_sums[ranges], counts + 0.5))
        rare = rank < 0
        return np.where(rare, 1 + ranges, 1 + len(RANGES) + rank), np.where(rare & (ranges > 0), np.minimum(share, 0), 0.0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


# ---- network ---------------------------------------------------------------------------------

N_SYMBOLS = 1 + len(RANGES) + FREQUENT


def fresh(lexicon: Lexicon, seed: int = 0) -> dict[str, np.ndarray]:
    """A network whose biases already give the unigram distribution."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    words = np.zeros(FREQUENT)
    words[: len(lexicon.top_counts)] = lexicon.top_counts
    by_class = words.reshape(-1, CLASS_WORDS)
    mass = np.concatenate([[lexicon.ends], lexicon.range_sums, by_class.sum(1)]) + 0.5
    return {
        "table": normal(N_SYMBOLS, 3 * HIDDEN), "inner": normal(HIDDEN, 3 * HIDDEN),
        "to_class": normal(HIDDEN, N_CLASSES) * 0.1, "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "to_word": normal(len(by_class), HIDDEN, CLASS_WORDS) * 0.1, "word_bias": np.log((by_class + 0.1) / (by_class + 0.1).sum(1, keepdims=True)).astype(np.float32),
    }


_WORD = np.arange(N_SYMBOLS) - 1 - len(RANGES)
#: Output class of a symbol and its place in it (-1 where the class has no softmax of its own). Short
#: integers, which numpy sorts by radix.
_CLASS = np.where(_WORD < 0, np.arange(N_SYMBOLS), 1 + len(RANGES) + _WORD // CLASS_WORDS).astype(np.int16)
_PLACE = np.where(_WORD < 0, -1, _WORD % CLASS_WORDS).astype(np.int16)


class Recurrence:
    """Steps of the network over windows of lanes, in buffers that all windows share."""

    def __init__(self, net: dict, steps: int, lanes: int):
        self.net, self.lanes = net, lanes
        wide = lambda k: np.empty((steps, lanes, k * HIDDEN), np.float32)
        self.gates, self.inner, self.new, self.previous, self.states = wide(2), wide(1), wide(1), wide(1), wide(1)
        self.goes_on = np.empty((steps, lanes, 1), np.float32)
        self.product = np.empty((lanes, 3 * HIDDEN), np.float32)

    def run(self, inputs: np.ndarray, state: np.ndarray) -> np.ndarray:
        """States after each of ``inputs`` (steps, lanes); the symbol that ends a text clears the state before it."""
        n, half = len(inputs), np.float32(0.5)
        seen = self.net["table"][inputs]
        np.copyto(self.goes_on[:n, :, 0], inputs > 0)
        for t in range(n):
            gates, inner, new, previous = self.gates[t], self.inner[t], self.new[t], self.previous[t]
            np.multiply(state, self.goes_on[t], out=previous)
            np.matmul(previous, self.net["inner"], out=self.product)
            inner[:] = self.product[:, 2 * HIDDEN :]
            # The logistic function as a hyperbolic tangent of half the argument.
            np.add(seen[t, :, : 2 * HIDDEN], self.product[:, : 2 * HIDDEN], out=gates)
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            np.multiply(gates[:, HIDDEN:], inner, out=new)
            new += seen[t, :, 2 * HIDDEN :]
            np.tanh(new, out=new)
            state = self.states[t]
            np.subtract(previous, new, out=state)
            state *= gates[:, :HIDDEN]
            state += new
        return self.states[:n]


def class_odds(net: dict, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all classes less the largest of the row, and their exponentials, both (classes, rows)."""
    logits = net["to_class"].T @ states.T
    logits += net["class_bias"][:, None]
    logits -= logits.max(0)
    return logits, np.exp(logits)


class Members:
    """Rows whose class has a softmax of its own, ordered by class."""

    def __init__(self, classes: np.ndarray, places: np.ndarray):
        words = np.flatnonzero(places >= 0)
        own = classes[words] - 1 - len(RANGES)
        order = np.argsort(own, kind="stable")
        self.rows, self.own, self.places = words[order], own[order], places[words][order]
        edges = np.searchsorted(self.own, np.arange(FREQUENT // CLASS_WORDS + 1))
        self.parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]

    def logits(self, net: dict, states: np.ndarray) -> np.ndarray:
        """Logits of the words of each row's class, less the largest of the row; ``states`` are those of ``rows``."""
        out = np.empty((len(states), CLASS_WORDS), np.float32)
        for k, part in self.parts:
            np.matmul(states[part], net["to_word"][k], out=out[part])
        out += net["word_bias"][self.own]
        out -= out.max(1, keepdims=True)
        return out


_ONES = np.ones(CLASS_WORDS, np.float32)


def log_likelihood(net: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target symbol given its state."""
    classes, places = _CLASS[targets], _PLACE[targets]
    logits, odds = class_odds(net, states)
    out = logits[classes, np.arange(len(targets))] - np.log(odds.sum(0))
    words = Members(classes, places)
    logits = words.logits(net, states[words.rows])
    chosen = logits[np.arange(len(words.rows)), words.places]
    out[words.rows] += chosen - np.log(np.exp(logits, out=logits) @ _ONES)
    return out


def lanes_of(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts (each ending in 0) dealt over lanes, longest first: symbols (steps, lanes), -1 where a lane has ended, and text numbers."""
    lanes = max(1, min(lanes, len(texts)))
    heap = [(0, k) for k in range(lanes)]
    own: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        load, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (load + len(texts[i]), k))
    height = max(load for load, _ in heap)
    symbols, number = np.full((height, lanes), -1, np.int32), np.full((height, lanes), -1, np.int32)
    for k, members in enumerate(own):
        if members:
            line = np.concatenate([texts[i] for i in members])
            symbols[: len(line), k] = line
            number[: len(line), k] = np.repeat(members, [len(texts[i]) for i in members])
    return symbols, number


def score_texts(net: dict, texts: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log-likelihood of whole texts; the state runs through each from its start to its end."""
    symbols, number = lanes_of(texts, lanes)
    scores = np.zeros(len(texts))
    state = np.zeros((symbols.shape[1], HIDDEN), np.float32)
    before = np.zeros(symbols.shape[1], np.int32)
    network = None
    for start in range(0, len(symbols), window):
        part = symbols[start : start + window]
        live = (part[0] >= 0).nonzero()[0]
        if len(live) < part.shape[1]:
            # A lane is one run of symbols, so a lane without one here has none later.
            state, before, symbols, number = state[live], before[live], symbols[:, live], number[:, live]
            part = symbols[start : start + window]
        if network is None or network.lanes != len(live):
            network = Recurrence(net, window, len(live))
        inputs = np.maximum(np.concatenate([before[None], part[:-1]]), 0)
        states = network.run(inputs, state)
        state, before = states[-1].copy(), part[-1]
        valid = part >= 0
        logs = log_likelihood(net, states[valid], part[valid])
        scores += np.bincount(number[start : start + window][valid], logs, len(texts))
    return scores


def train(net: dict, line: np.ndarray, updates: int = 1, rate: float = 0.08) -> dict:
    """Adagrad with truncated backpropagation over a line of texts, cut into equal lanes; states are carried along a lane.

    The line is passed as often as ``updates`` asks, once at least.
    """
    net = {k: v.copy() for k, v in net.items()}
    squares = {k: np.full_like(v, 0.1) for k, v in net.items()}
    if not len(line):
        return net
    lanes = int(np.clip(len(line) // (40 * STEPS), 8, LANES))
    height = -(-len(line) // lanes)
    symbols = np.full(lanes * height, -1, np.int32)
    symbols[: len(line)] = line
    symbols = symbols.reshape(lanes, height).T
    network = Recurrence(net, STEPS, lanes)
    d_inner = np.empty((STEPS, lanes, 3 * HIDDEN), np.float32)
    d_new, d = np.empty((STEPS, lanes, HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32)
    for _ in range(-(-updates // -(-height // STEPS))):
        state = np.zeros((lanes, HIDDEN), np.float32)
        before = np.zeros(lanes, np.int32)
        for start in range(0, height, STEPS):
            part = symbols[start : start + STEPS]
            valid = part >= 0
            if not valid.any():
                break
            steps = len(part)
            inputs = np.maximum(np.concatenate([before[None], part[:-1]]), 0)
            states = network.run(inputs, state)
            flat, targets = states[valid], part[valid]
            n = np.float32(1 / len(targets))
            classes, places = _CLASS[targets], _PLACE[targets]
            _, delta = class_odds(net, flat)
            delta /= delta.sum(0)
            delta[classes, np.arange(len(targets))] -= 1
            delta *= n
            grads = {"to_class": flat.T @ delta.T, "class_bias": delta.sum(1)}
            back = (net["to_class"] @ delta).T.copy()
            words = Members(classes, places)
            word_states = flat[words.rows]
            delta = words.logits(net, word_states)
            np.exp(delta, out=delta)
            delta /= (delta @ _ONES)[:, None]
            delta[np.arange(len(words.rows)), words.places] -= 1
            delta *= n
            word_back = np.empty_like(word_states)
            grads["to_word"], grads["word_bias"] = np.zeros_like(net["to_word"]), np.zeros_like(net["word_bias"])
            for k, rows in words.parts:
                grads["to_word"][k], grads["word_bias"][k] = word_states[rows].T @ delta[rows], delta[rows].sum(0)
                np.matmul(delta[rows], net["to_word"][k].T, out=word_back[rows])
            back[words.rows] += word_back
            d_states = np.zeros_like(states)
            d_states[valid] = back
            # What does not depend on the later steps is worked out for all steps at once.
            gates, new, previous = network.gates[:steps], network.new[:steps], network.previous[:steps]
            keep, reset, inner = gates[..., :HIDDEN], gates[..., HIDDEN:], network.inner[:steps]
            rest = 1 - keep
            to_new, to_keep, to_reset = rest * (1 - new * new), (previous - new) * keep * rest, inner * reset * (1 - reset)
            carried, back_inner = np.float32(0), np.ascontiguousarray(net["inner"].T)
            for t in reversed(range(steps)):
                np.add(d_states[t], carried, out=d)
                np.multiply(d, to_new[t], out=d_new[t])
                np.multiply(d, to_keep[t], out=d_inner[t, :, :HIDDEN])
                np.multiply(d_new[t], to_reset[t], out=d_inner[t, :, HIDDEN : 2 * HIDDEN])
                np.multiply(d_new[t], reset[t], out=d_inner[t, :, 2 * HIDDEN :])
                carried = d_inner[t] @ back_inner
                carried += d * keep[t]
                carried *= network.goes_on[t]
            flat_inner = d_inner[:steps].reshape(-1, 3 * HIDDEN)
            grads["inner"] = previous.reshape(-1, HIDDEN).T @ flat_inner
            state, before = states[-1].copy(), part[-1]
            # The table: only the rows of symbols that were seen have a gradient.
            flat_inner[:, 2 * HIDDEN :] = d_new[:steps].reshape(-1, HIDDEN)
            short = inputs.ravel().astype(np.int16)
            order = np.argsort(short, kind="stable")
            ranked = short[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            seen, by_symbol = ranked[first], np.add.reduceat(flat_inner[order], first, axis=0)
            by_symbol *= len(targets) * np.float32(0.05)
            squares["table"][seen] += by_symbol * by_symbol
            net["table"][seen] -= rate * by_symbol / np.sqrt(squares["table"][seen])
            for k, g in grads.items():
                squares[k] += g * g
                g *= np.float32(rate)
                g /= np.sqrt(squares[k])
                net[k] -= g
    return net


# ---- the jobs --------------------------------------------------------------------------------


def figures(row: dict, lexicon: Lexicon, training: bool):
    """Symbol, training count and log10 share of each of a block's words, by frequency (training: as if held out)."""
    order = from_planes(row["by_frequency"])
    words = np.frombuffer(row["known"], np.uint64)[order]
    counts = np.frombuffer(row["totals"], np.int64)[order]
    symbols, share = lexicon.symbols(words, np.maximum(counts - 1, 0) if training else counts)
    return symbols.astype(np.int32), counts, share


def sequences(symbols: np.ndarray, index: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Symbols of every text, each with its end."""
    line, ends = symbols[index], np.cumsum(lengths)
    return [np.append(line[e - n : e], np.int32(0)) for e, n in zip(ends, lengths)]


def prepared(lexicon: Lexicon, joined: DataFrame) -> DataFrame:
    """Blocks with the symbols of their words, as training and as scoring see them, and the sums that need no network."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shown, _, _ = figures(row, lexicon, True)
                symbols, counts, share = figures(row, lexicon, False)
                index, lengths = from_planes(row["words"]), np.array(row["lengths"], np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                per_text = lambda values: np.bincount(owner, values[index], len(lengths))  # noqa: B023, E731
                sums = [per_text(v).tolist() for v in ((counts > 0).astype(float), lexicon.base(counts), share)]
                line = [row["block"], row["ids"], row["held"], row["lengths"], row["words"], to_planes(shown), to_planes(symbols), *sums]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(line, kinds.values())], names=list(kinds))

    binary, doubles = pa.binary(), pa.list_(pa.float64())
    kinds = {
        "block": pa.string(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "words": binary,
        "shown": binary, "symbols": binary, "known": doubles, "base": doubles, "share": doubles,
    }
    return joined.mapInArrow(
        run,
        "block string, ids array<long>, held array<boolean>, lengths array<int>, words binary, "
        "shown binary, symbols binary, known array<double>, base array<double>, share array<double>",
    )


def training_line(row: dict) -> np.ndarray:
    """All training texts of a block as one line of symbols."""
    texts = sequences(from_planes(row["shown"]), from_planes(row["words"]), row["lengths"])
    return np.concatenate([np.zeros(0, np.int32), *(t for t, out in zip(texts, row["held"]) if not out)])


def flatten(net: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def unflatten(net: dict, flat: np.ndarray) -> dict:
    out, at = {}, 0
    for k, v in net.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def averaged(blocks: DataFrame, net: dict, n_blocks: int, pieces: int = 16) -> dict:
    """One pass of every block's own copy, and their mean."""

    def own_copy(batches):
        for batch in batches:
            for row in batch.to_pylist():
                line = training_line(row)
                if len(line):
                    weight = float(len(line))
                    flat = flatten(train(net, line, 1, PASS_RATE)) * np.float32(weight)
                    data = [p.tobytes() for p in np.array_split(flat, pieces)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(pieces), pa.int32()), pa.array([row["block"]] * pieces), pa.array([weight] * pieces), pa.array(data, pa.binary())],
                        names=["piece", "block", "weight", "data"],
                    )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4)
        for data in pdf["data"]:
            total += np.frombuffer(data, np.float32)
        total = total.astype(np.float32)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "weight": [pdf["weight"].sum()], "data": [total.tobytes()]})

    schema = "piece int, weight double, data binary"
    copies = blocks.mapInArrow(own_copy, "piece int, block string, weight double, data binary")
    # First within groups of about 64 blocks, then over the groups.
    group = F.pmod(F.xxhash64("block"), F.lit(1 + n_blocks // 64))
    first = copies.groupBy("piece", group.alias("group")).applyInPandas(add, schema)
    rows = sorted(first.groupBy("piece").applyInPandas(add, schema).collect(), key=lambda r: r["piece"])
    if not rows:
        return net
    return unflatten(net, np.concatenate([np.frombuffer(r["data"], np.float32) / r["weight"] for r in rows]))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Base and network log10 likelihood of every whole text."""
    blocks = common.stage(to_blocks(docs, held_out), "blocks")
    counted = common.stage(count_words(blocks), "counts")
    facts = blocks.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("training")).first()
    n_blocks, n_train = facts["n"], facts["training"] or 0
    if not n_blocks:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    lexicon = Lexicon(counted, n_train)

    def together(batches):
        for batch in batches:
            parts = [b"".join(x["data"] for x in sorted(xs, key=lambda x: x["shard"])) for xs in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(parts, pa.binary())], names=["block", "totals"])

    totals = counted.where("kind = 'block'").groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("parts"))
    totals = totals.mapInArrow(together, "block string, totals binary")
    # Joined once and kept: training and scoring read the same rows.
    ready = common.stage(prepared(lexicon, blocks.drop("counts").join(totals, "block")), "symbols")
    learned = ready.select("block", "held", "lengths", "words", "shown")

    net = fresh(lexicon)

    def lines(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([training_line(row)[:WARM_TOKENS].tobytes()], pa.binary())], names=["block", "line"]
                )

    # A bounded start: up to WARM_TOKENS of each of a few blocks, picked by the hash of their names.
    names = [r["block"] for r in ready.select("block").orderBy(F.xxhash64("block"), "block").limit(WARM_BLOCKS).collect()]
    some = learned.where(F.col("block").isin(names)).mapInArrow(lines, "block string, line binary").collect()
    start = [np.frombuffer(bytes(r["line"]), np.int32) for r in sorted(some, key=lambda r: r["block"])]
    net = train(net, np.concatenate(start), WARM_UPDATES)
    net = averaged(learned, net, n_blocks)
    ends, tokens, end_score = lexicon.ends, lexicon.tokens, lexicon.base(np.array([lexicon.ends]))[0]

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = sequences(from_planes(row["symbols"]), from_planes(row["words"]), row["lengths"])
                lengths = np.array(row["lengths"], np.int64)
                out = {
                    "doc_id": row["ids"], "held_out": row["held"], "n_tokens": lengths + 1,
                    "n_known": np.array(row["known"]).astype(np.int64) + (ends > 0),
                    "train_tokens": np.full(len(lengths), tokens), "base_score": np.array(row["base"]) + end_score,
                    "score": score_texts(net, texts) / np.log(10) + np.array(row["share"]),
                }
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return ready.select("ids", "held", "lengths", "words", "symbols", "known", "base", "share").mapInArrow(score, SCHEMA)
