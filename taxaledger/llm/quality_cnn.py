"""Quality classifier: a byte-level convolutional network in numpy.

``FILTERS`` filters over ``WIDTH`` bytes run over the whole text; their outputs
are max-pooled over chunks of two ``BLOCK``s that overlap by one. A logistic
unit scores each chunk; the mean over all chunks, calibrated on training
documents, is the one probability of a document. Gradients of a max pool reach
one position per filter and chunk, so training is a sparse update.

The network is fitted on the driver on a bounded sample of labelled rows
(``PER_LABEL`` rows a label, ``LABEL_CHARS`` characters a label, see
``training_rows``), on all chunks of these rows' whole texts; a text's chunks
count together as the square root of their number. Scoring covers every byte of
every text, one slice at a time, without a shuffle.

Defined results: a null or empty text is one chunk of padding and scores as the
network says; without labelled rows, or with one label only, every score is the
share of label 1 (0.5 without any); a null doc_id counts as not held out;
repeated rows are scored each; an empty table gives no rows; a very long text is
scored whole in its task, a block after the other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.texts import slices
from taxaledger.llm.training_rows import thinned, training_texts
from taxaledger.session import write_stage

WIDTH = 6
FILTERS = 32
BLOCK = 128
PER_LABEL = 1200
LABEL_CHARS = 4_000_000
EPOCHS = 6
THRESHOLD = 0.3


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in whole blocks (padded with zeros, and WIDTH more at the end), blocks of each text, first block of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks = np.maximum(1, -(-lengths // BLOCK))
    first = np.concatenate(([0], np.cumsum(blocks)))
    data = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    for text, at in zip(texts, first[:-1].tolist(), strict=True):
        data[at * BLOCK : at * BLOCK + len(text)] = np.frombuffer(text, np.uint8)
    return data, blocks, first[:-1]


def pair_tables(net: Network) -> list[np.ndarray]:
    """The filters' parts for two bytes at once."""
    return [(net.taps[k][:, None, :] + net.taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def pooled_blocks(data: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The highest output of each filter in each block."""
    n = (len(data) - WIDTH) // BLOCK
    pairs = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
    out = np.empty((n, tables[0].shape[1]), np.float32)
    step = 256
    for b in range(0, n, step):
        m = min(step, n - b)
        at, size = b * BLOCK, m * BLOCK
        got = tables[0].take(pairs[at : at + size], axis=0)
        for k in range(1, len(tables)):
            got += tables[k].take(pairs[at + 2 * k : at + 2 * k + size], axis=0)
        out[b : b + m] = got.reshape(m, BLOCK, -1).max(axis=1)
    return out + bias


def chunk_logits(pooled: np.ndarray, blocks: np.ndarray, first: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all chunks and the text that each belongs to."""
    text = np.repeat(np.arange(len(blocks)), blocks)
    last = np.zeros(len(text), bool)
    last[first + blocks - 1] = True
    following = np.minimum(np.arange(len(text)) + 1, len(text) - 1)
    chunks = np.maximum(pooled, np.where(last[:, None], pooled, pooled[following]))
    chunk = ~last | (blocks[text] == 1)  # a last block is in the chunk before it
    return (np.maximum(chunks, 0) @ net.out + net.out_bias)[chunk], text[chunk]


def text_logits(texts: list[bytes], net: Network, tables: list[np.ndarray]) -> np.ndarray:
    data, blocks, first = laid_out(texts)
    logits, text = chunk_logits(pooled_blocks(data, tables, net.bias), blocks, first, net)
    return np.bincount(text, logits, len(texts)) / np.bincount(text, minlength=len(texts))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, str]], seed: int = 7) -> Network:
    """The network for (label, text) of training documents."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for y, _ in rows], np.float32)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    size = 2 * BLOCK
    chunks, targets, shares = [], [], []
    for y, text in rows:
        raw = text.encode()
        cut = [raw[i : i + size] for i in range(0, max(1, len(raw) - BLOCK), BLOCK)]
        chunks += cut
        targets += [y] * len(cut)
        shares += [len(cut) ** -0.5] * len(cut)
    data = np.zeros((len(chunks), size + WIDTH), np.uint8)
    for i, c in enumerate(chunks):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
    y = np.array(targets, np.float32)
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32)
    weight *= (np.array(shares) / np.mean(shares)).astype(np.float32)
    grads2 = [np.full_like(a, 1e-6) for a in (net.taps, net.bias, net.out)]
    bias2, batch = 1e-6, 128
    positions = np.arange(size)
    for epoch in range(EPOCHS):
        rate = 0.05 * 0.85**epoch
        order = rng.permutation(len(y))
        for b in range(0, len(y), batch):
            rows_ = order[b : b + batch]
            d = data[rows_]
            got = net.taps[0].take(d[:, positions], axis=0)
            for k in range(1, WIDTH):
                got += net.taps[k].take(d[:, positions + k], axis=0)
            best = got.argmax(axis=1)  # rows x filters
            z = np.take_along_axis(got, best[:, None, :], axis=1)[:, 0] + net.bias
            a = np.maximum(z, 0)
            g = (_sigmoid(a @ net.out + net.out_bias) - y[rows_]) * weight[rows_] / len(rows_)
            dz = g[:, None] * net.out * (z > 0)
            d_out, d_bias, d_b = a.T @ g, dz.sum(0), float(g.sum())
            d_taps = np.zeros_like(net.taps)
            for k in range(WIDTH):
                byte = np.take_along_axis(d, best + k, axis=1)
                np.add.at(d_taps[k], (byte, np.arange(FILTERS)), dz)
            for p, grad, sq in zip((net.taps, net.bias, net.out), (d_taps, d_bias, d_out + 1e-4 * net.out), grads2, strict=True):
                sq += grad * grad  # AdaGrad
                p -= (rate * grad / np.sqrt(sq)).astype(np.float32)
            bias2 += d_b * d_b
            net.out_bias -= rate * d_b / bias2**0.5
    tables = pair_tables(net)
    x = text_logits([t.encode() for _, t in rows], net, tables)
    # Calibration with classes weighed alike, so that neither label's share in the sample counts.
    w = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(scale * x + shift)
        e, h = w * (p - labels), w * p * (1 - p) + 1e-9
        a, b, c = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        gs, gb = (e * x).sum() + 1e-3 * scale, e.sum() + 1e-3 * shift
        det = a * c - b * b
        scale, shift = scale - (c * gs - b * gb) / det, shift - (a * gb - b * gs) / det
    net.scale, net.shift = float(scale), float(shift)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on documents that are not held out; the bounds are those of the module."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    # Thinned before any text is read.
    chosen = write_stage(thinned(marks, PER_LABEL, "doc_id").distinct())
    return fit(training_texts(own.join(chosen, "doc_id"), PER_LABEL, LABEL_CHARS))


def held_out(mod: int = 5, rest: int = 0, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, score) of every text, or the columns to keep and ``_score``."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = pair_tables(net) if net.constant is None else None
        for batch in slices(batches, "_text"):
            texts = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            if net.constant is None:
                p = _sigmoid(net.scale * text_logits(texts, net, tables) + net.shift)
            else:
                p = np.full(len(texts), net.constant)
            rest = [c for c in range(batch.num_columns) if c != text_at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(p, pa.float64())], names=names)

    own = docs.select(F.col(id_col).cast("long").alias("_id"), *[F.col(f"`{k}`").alias(f"_keep{i}") for i, k in enumerate(keep or ())], F.col(text_col).cast("string").alias("_text"))
    text_at = len(own.columns) - 1
    names = [*own.columns[:-1], "_score"]
    types = dict(own.dtypes)
    got = own.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in own.columns[:-1]) + ", _score double")
    if keep is None:
        return got.select(F.col("_id").alias("doc_id"), F.col("_score").alias("score"))
    return got.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], "_score")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
