"""Stretches of a text that repeat the same words over and over.

Each text is worked through as a whole where it lies: words become numbers, and
``diagonals`` finds the runs. Nothing is shuffled, so copies of one text and
frequent words put no load on any one task.

Defined results: a null text has no words and no runs; so has a text without
words. Null doc_ids stay null and are never reordered; rows of equal doc_id are
separate; other columns are not read; an empty table gives an empty result. A
text longer than a slice is a slice of its own: it is held whole, with some
hundred bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.diagonals import runs
from taxaledger.llm.texts import id_and_text, slices

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

#: Gives for (doc_id, words of the text) the numbers of the words to read, or None for the words as they stand.
Order = Callable[[int | None, int], np.ndarray | None]


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of every tenth document (by checksum of its id) repeat from some word on."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def _slice(ids: list, texts: list[bytes | None], order: Order | None) -> tuple[list, list, list]:
    words, sizes = [], []
    for doc_id, text in zip(ids, texts, strict=True):
        own = text.split() if text else []  # bytes: the six ASCII blanks only
        changed = order(doc_id, len(own)) if order else None
        words.extend(own if changed is None else map(own.__getitem__, changed.tolist()))
        sizes.append(len(own))
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    firsts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    found = runs(numbers, np.repeat(np.arange(len(sizes)), sizes))
    # After a run's first period its words go.
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(step[:-1]) == 0
    owner = np.searchsorted(firsts, found[:, 0], side="right") - 1
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    lists, kept = [], []
    for d in range(len(sizes)):
        a, b = int(firsts[d]), int(firsts[d + 1])
        own = found[edges[d] : edges[d + 1]]
        lists.append([{"start": s - a, "length": n, "period": q} for s, n, q in own.tolist()])
        kept.append(b" ".join(words[a:b] if not len(own) else [words[i] for i in (np.flatnonzero(stays[a:b]) + a).tolist()]))
    return sizes, lists, kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Order | None = None) -> DataFrame:
    """(doc_id, n_words, runs by start and period, the text without the repeats, one space between words)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id")
            sizes, lists, kept = _slice(ids.to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), order)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(step, SCHEMA)


def strongest(runs_col: str = "runs") -> Column:
    """The run whose length is the most periods, compared exactly; the first of equal ones, or null."""
    return F.aggregate(F.col(runs_col), F.try_element_at(F.col(runs_col), F.lit(1)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))


def digests(found: DataFrame) -> DataFrame:
    best = found.withColumn("best", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
