"""Language identification: a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units read each run of ``STEPS`` bytes from both
sides; a softmax over both states labels every position; a document's
probabilities are the mean over all its bytes. The network is trained in numpy
by backpropagation through time, on the driver, on a bounded sample
(``PER_LABEL`` rows and ``LABEL_CHARS`` characters a language, see
``training_rows``): each step draws its runs from anywhere in the whole texts.
A row trains under its own language only. Prediction reads every byte of every text, many runs side by side, one
slice at a time, without a shuffle.

Defined results: ``und`` with score 0 for a null text or one without a letter;
without any training row all texts are ``und``; a null doc_id counts as not
held out and never trains; repeated rows are scored each; of equally likely
languages the first by name is said; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.texts import id_and_text, slices
from taxaledger.llm.training_rows import thinned, training_texts

UNITS = 8
STEPS = 96
ROWS = 4096
PER_LABEL = 600
LABEL_CHARS = 4_000_000
BATCHES = 260
RATE = 0.02


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(w: dict[str, np.ndarray], side: str, data: np.ndarray, keep: bool = False):
    """States of one direction after each step: steps x rows x units."""
    table, inner = w[f"in_{side}"], w[f"re_{side}"]
    n, h, u = data.shape[1], np.zeros((data.shape[1], UNITS), np.float32), UNITS
    states, kept = np.empty((len(data), n, u), np.float32), []
    for t in range(len(data)) if side == "l" else range(len(data) - 1, -1, -1):
        x = table.take(data[t], axis=0)
        gates = _sigmoid(x[:, : 2 * u] + h @ inner[:, : 2 * u])
        z, r = gates[:, :u], gates[:, u:]
        q = h @ inner[:, 2 * u :]
        c = np.tanh(x[:, 2 * u :] + r * q)
        new = c + z * (h - c)
        if keep:
            kept.append((t, h, z, r, q, c))
        states[t] = h = new
    return states, kept


def backward(w, side, data, kept, d_states, grads) -> None:
    """Backpropagation through time of one direction."""
    inner, u = w[f"re_{side}"], UNITS
    d_h = np.zeros_like(d_states[0])
    for t, h, z, r, q, c in reversed(kept):
        d_h = d_h + d_states[t]
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (h - c) * z * (1 - z)
        d_r = d_c * q * r * (1 - r)
        d_x = np.concatenate((d_z, d_r, d_c), axis=1)
        d_a = np.concatenate((d_z, d_r, d_c * r), axis=1)
        np.add.at(grads[f"in_{side}"], data[t], d_x)
        grads[f"re_{side}"] += h.T @ d_a
        d_h = d_h * z + d_a @ inner.T


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Network:
    """The network for (language, text) of training documents."""
    langs = sorted({y for y, _ in rows})
    net = Network(langs)
    if not langs:
        return net
    rng = np.random.default_rng(seed)
    u, k = UNITS, len(langs)
    w = net.weights
    for side in "lr":
        w[f"in_{side}"] = rng.normal(0, 0.3, (256, 3 * u)).astype(np.float32)
        w[f"re_{side}"] = rng.normal(0, 0.3, (u, 3 * u)).astype(np.float32)
    w["out"] = rng.normal(0, 0.3, (2 * u, k)).astype(np.float32)
    w["bias"] = np.zeros(k, np.float32)
    by_lang = [[t.encode() for y, t in rows if y == lang] for lang in langs]
    m1 = {a: np.zeros_like(x) for a, x in w.items()}
    m2 = {a: np.zeros_like(x) for a, x in w.items()}
    size = 256
    for step in range(1, BATCHES + 1):
        y = np.arange(size) % k
        data = np.zeros((STEPS, size), np.uint8)
        real = np.zeros((STEPS, size), np.float32)
        for i, lang in enumerate(y):
            piece = by_lang[lang][rng.integers(len(by_lang[lang]))]
            at = rng.integers(max(1, len(piece) - STEPS + 1))
            cut = np.frombuffer(piece[at : at + STEPS], np.uint8)
            data[: len(cut), i] = cut
            real[: len(cut), i] = 1
        left, kept_l = forward(w, "l", data, True)
        right, kept_r = forward(w, "r", data, True)
        both = np.concatenate((left, right), axis=2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        d = p.copy()
        d[:, np.arange(size), y] -= 1
        d *= (real / real.sum())[:, :, None]
        grads = {a: np.zeros_like(x) for a, x in w.items()}
        grads["out"] = both.reshape(-1, 2 * u).T @ d.reshape(-1, k)
        grads["bias"] = d.sum((0, 1))
        d_both = d @ w["out"].T
        backward(w, "l", data, kept_l, d_both[:, :, :u], grads)
        backward(w, "r", data, kept_r, d_both[:, :, u:], grads)
        for a in w:  # Adam
            m1[a] = 0.9 * m1[a] + 0.1 * grads[a]
            m2[a] = 0.99 * m2[a] + 0.01 * grads[a] ** 2
            w[a] = (w[a] - RATE * 0.99**step * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def probabilities(texts: list[bytes], net: Network) -> np.ndarray:
    """The mean of the probabilities at all bytes of each text (0 for an empty text)."""
    k, lengths = len(net.langs), np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-lengths // STEPS)
    owner = np.repeat(np.arange(len(texts)), rows)
    data = np.zeros(int(rows.sum()) * STEPS, np.uint8)
    at = 0
    for text, n in zip(texts, rows.tolist(), strict=True):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * STEPS
    data = data.reshape(-1, STEPS)
    row_of = np.arange(len(data)) - np.repeat(np.cumsum(rows) - rows, rows)
    left_over = np.minimum(STEPS, lengths[owner] - row_of * STEPS)
    total = np.zeros((len(texts), k))
    for b in range(0, len(data), ROWS):
        part = np.ascontiguousarray(data[b : b + ROWS].T)
        states = np.concatenate((forward(net.weights, "l", part)[0], forward(net.weights, "r", part)[0]), axis=2)
        logits = states @ net.weights["out"] + net.weights["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p *= (np.arange(STEPS)[:, None] < left_over[b : b + ROWS])[:, :, None]
        np.add.at(total, owner[b : b + ROWS], p.sum(axis=0))
    return total / np.maximum(1, lengths)[:, None]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fit on documents with a language that are not held out; the bounds are those of the module."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    return fit(training_texts(thinned(own.filter(~held_out()), PER_LABEL, "doc_id"), PER_LABEL, LABEL_CHARS))


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in slices(batches):
            ids, texts, known = batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("letters").to_pylist()
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            asked = [i for i, k in enumerate(known) if k] if net.langs else []
            if asked:
                p = probabilities([texts[i].encode() for i in asked], net)
                names[asked] = np.array(net.langs, object)[p.argmax(axis=1)]
                scores[asked] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = id_and_text(docs, id_col, text_col).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
