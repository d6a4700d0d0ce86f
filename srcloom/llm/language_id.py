"""Language identification by a byte convolutional network.

Texts are lower-cased and cut into fixed windows of bytes that overlap by the widest
filter, so the windows cover the whole text. Filters of several widths run over the
bytes of a window, each keeps its maximum, and a softmax layer turns the maxima into
language probabilities. The network is trained in numpy on a bounded sample of labelled
texts (``docs_per_language``, ``windows_per_doc``), taken by a hash of the id; the
weights are a few hundred kB. A text's score is the renormalised geometric mean of its
windows' probabilities, weighted by their letters.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without any
labelled row every text is ``und``; null ids are kept; an empty table gives an empty
table; repeated rows give repeated rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm import common

SCHEMA = "doc_id long, lang_pred string, score double"
WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 128
OVERLAP = max(WIDTHS) - 1
#: Windows that are convolved at once.
BLOCK = 2048

_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, the last filled up with zero bytes."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    step = WINDOW - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def convolve(tables: list[np.ndarray], windows: np.ndarray) -> list[np.ndarray]:
    """Filter responses per width: (windows, places, filters). A filter over one-hot bytes is a sum of table rows."""
    out = []
    for table in tables:
        width = len(table)
        places = windows.shape[1] - width + 1
        total = table[0][windows[:, :places]]
        for j in range(1, width):
            total += table[j][windows[:, j : j + places]]
        out.append(total)
    return out


def softmax_log(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def log_probabilities(model: dict, windows: np.ndarray) -> np.ndarray:
    parts = []
    for start in range(0, len(windows), BLOCK):
        pooled = np.concatenate([r.max(1) for r in convolve(model["tables"], windows[start : start + BLOCK])], 1)
        parts.append(softmax_log(np.maximum(pooled + model["bias"], 0) @ model["out"] + model["out_bias"]))
    return np.concatenate(parts)


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = 400, batch: int = 128, seed: int = 0) -> dict:
    """Adam on the cross-entropy of single windows; classes are drawn evenly."""
    rng = np.random.default_rng(seed)
    units = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(units, np.float32), rng.normal(0, 0.1, (units, n_labels)).astype(np.float32), np.zeros(n_labels, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    for step in range(1, steps + 1):
        wanted = rng.integers(0, n_labels, batch)
        rows = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in wanted])
        x = windows[rows]
        responses = convolve(params[:-3], x)
        best = [r.argmax(1) for r in responses]
        pooled = np.concatenate([np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(responses, best)], 1) + params[-3]
        hidden = np.maximum(pooled, 0)
        delta = np.exp(softmax_log(hidden @ params[-2] + params[-1]))
        delta[np.arange(batch), wanted] -= 1
        delta /= batch
        back = (delta @ params[-2].T) * (pooled > 0)
        grads = []
        for k, (width, b) in enumerate(zip(WIDTHS, best)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros((width, 256, FILTERS), np.float32)
            for j in range(width):
                np.add.at(grad[j], (np.take_along_axis(x, b + j, 1), np.arange(FILTERS)), own)
            grads.append(grad)
        grads += [back.sum(0), hidden.T @ delta, delta.sum(0)]
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return {"tables": params[:-3], "bias": params[-3], "out": params[-2], "out_bias": params[-1]}


def sample(docs: DataFrame, learn_from: Column, docs_per_language: int) -> DataFrame:
    """Up to twice ``docs_per_language`` distinct rows of each label, since texts without a letter go later."""
    labelled = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("pick"),
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("pick").alias("n")).collect()}
    # One in 2**63 hash values per row: the share that holds about the wanted number, with a margin.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * docs_per_language / max(1, n)))).otherwise(share)
    order = F.shiftrightunsigned("pick", 1)
    chosen = labelled.where(order < share * float(1 << 63)).groupBy("lang", "pick").agg(F.min("text").alias("text"))
    # A hard limit, first within salts of a label, then over them.
    chosen = chosen.withColumn("salt", F.pmod(F.col("pick"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        w = Window.partitionBy(*keys).orderBy(order, "pick")
        chosen = chosen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * docs_per_language)
    return chosen.select("lang", "text", "pick")


def fit(docs: DataFrame, learn_from: Column, docs_per_language: int = 400, windows_per_doc: int = 16) -> dict:
    """Train on at most ``docs_per_language`` texts of each label, ``windows_per_doc`` evenly spaced windows of each."""
    chosen = sample(docs, learn_from, docs_per_language)

    def cut(batches):
        import pyarrow as pa

        for batch in common.slices(batches):
            langs, picks, rows = batch.column("lang").to_pylist(), batch.column("pick").to_pylist(), []
            for text in batch.column("text").to_pylist():
                if _LETTER.search(text):
                    w = windows_of(text)
                    rows.append(w[np.unique(np.linspace(0, len(w) - 1, windows_per_doc).astype(int))].tobytes())
                else:
                    rows.append(b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(picks, pa.int64()), pa.array(rows, pa.binary())],
                names=["lang", "pick", "windows"],
            )

    rows = chosen.mapInArrow(cut, "lang string, pick long, windows binary").collect()
    rows = sorted((r for r in rows if r["windows"]), key=lambda r: (r["lang"], r["pick"], bytes(r["windows"])))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return {"languages": []}
    windows, labels = [], []
    for k, lang in enumerate(languages):
        for r in [r for r in rows if r["lang"] == lang][:docs_per_language]:
            w = np.frombuffer(bytes(r["windows"]), np.uint8).reshape(-1, WINDOW)
            windows.append(w)
            labels.append(np.full(len(w), k))
    model = train(np.concatenate(windows), np.concatenate(labels), len(languages))
    return model | {"languages": languages}


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def predict(model: dict, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model["languages"]:
        return langs, scores
    seen: dict[str, int] = {}
    todo = []
    for i, text in enumerate(texts):
        if text is not None and text not in seen and _LETTER.search(text):
            seen[text] = i
            todo.append(i)
    start = 0
    while start < len(todo):
        parts, size, end = [], 0, start
        while end < len(todo) and size < BLOCK:
            parts.append(windows_of(texts[todo[end]]))
            size += len(parts[-1])
            end += 1
        windows = np.concatenate(parts)
        logs = log_probabilities(model, windows)
        # Letters of a window: ASCII letters and all bytes of longer characters; a trace for the others.
        weight = ((windows >= 97) & (windows <= 122) | (windows >= 128)).sum(1) + 1e-3
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        mean = np.add.reduceat(logs * weight[:, None], begins) / np.add.reduceat(weight, begins)[:, None]
        probabilities = np.exp(softmax_log(mean))
        for i, row in zip(todo[start:end], probabilities):
            k = int(row.argmax())
            langs[i], scores[i] = model["languages"][k], min(1.0, float(row[k]))
        start = end
    for i, text in enumerate(texts):
        if text in seen:
            langs[i], scores[i] = langs[seen[text]], scores[seen[text]]
    return langs, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Language and score of every whole text."""

    def run(texts):
        langs, scores = predict(model, texts)
        return {"lang_pred": langs, "score": scores}

    return common.id_and_text(docs).mapInArrow(common.per_text(run, SCHEMA), SCHEMA)
