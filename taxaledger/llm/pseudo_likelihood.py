"""Scores by masked pseudo-likelihood: the log-probabilities of all words, each given both sides.

1. Word counts over all documents, pre-aggregated in each task, are written
   whole. The ``KNOWN`` most frequent words (ties to the smaller hash) are the
   network's own; it sees the others as ``OTHER`` classes by their hash.
2. Training covers every word of every document, ``ROUNDS`` times: each task
   trains a copy of the network on its own documents, and the copies' average,
   weighted by words, is the next network. What is gathered is one copy per
   task, summed in a tree: it grows with the input, the driver holds one.
3. A second pass sums the log-probabilities of each document. A word of a class
   has its class's probability times its share of the class's count, so the
   probabilities of all words that occur add up to 1. Counts over a ``HELD``th
   of all words (at most ``HELD`` words) are broadcast; the other words' counts
   are joined by hash, each word once per document, so none of them is hot.

Defined results: a null or empty text, or one without words, has 0 words, sum
0 and mean 0; an empty table gives none; a null doc_id stays null; repeated
rows train and score each; other columns are not read. Averages depend on how
Spark splits the input, so scores can differ a little between cluster sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm import window_network as net
from taxaledger.llm.texts import id_and_text, slices
from taxaledger.llm.word_hashes import Words
from taxaledger.session import write_stage

OTHER = 127
KNOWN = net.VOCAB - OTHER - 1  # word 0 stands beyond a text's ends
ROUNDS = 2
#: Distinct words that a task holds before it passes on its counts.
HELD_WORDS = 1_000_000
#: Most words whose counts each task holds while it scores.
HELD = 1 << 16


def _words(batch: pa.RecordBatch) -> Words:
    return Words([(t or "").encode() for t in batch.column("text").to_pylist()])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash and number of every word of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in slices(batches):
            new, n = np.unique(_words(batch).hash, return_counts=True)
            held, at = np.unique(np.concatenate((held, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(held)).astype(np.int64)
            if len(held) > HELD_WORDS:
                yield told()
                held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield told()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in order, word number, count) of the network's own words."""
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], 1 + order, np.array([r["n"] for r in top], np.int64)[order]


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, word number of each) of the most frequent words."""
    return _most_frequent(word_counts(docs))[:2]


def class_counts(counts: DataFrame, known: np.ndarray, n_known: np.ndarray) -> tuple[np.ndarray, int]:
    """(words in each class without the network's own, all words) of (word, n)."""
    # Spark has no unsigned numbers: a negative hash stands for one larger by 2**64.
    cls = F.pmod(F.pmod("word", F.lit(OTHER)) + F.when(F.col("word") < 0, pow(2, 64, OTHER)).otherwise(0), F.lit(OTHER))
    out = np.zeros(OTHER, np.int64)
    for r in counts.groupBy(cls.alias("cls")).agg(F.sum("n").alias("n")).collect():
        out[r["cls"]] = r["n"]
    total = int(out.sum())
    np.subtract.at(out, (known % np.uint64(OTHER)).astype(np.int64), n_known)
    return out, total


def held_counts(counts: DataFrame, total: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the words that make up over a ``held``th of all."""
    rows = counts.filter(F.col("n") > total // held).collect()
    hashes = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], np.int64)[order]


def _found(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the ordered ``of``, whether there)."""
    if not len(of):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(of, hashes), len(of) - 1)
    return at, of[at] == hashes


def numbered(hashes: np.ndarray, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The word numbers of hashes; the most frequent word is 1, other words follow the known."""
    other = KNOWN + 1 + (hashes % np.uint64(OTHER)).astype(np.int64)
    if not len(known):
        return other
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, number[at], other)


def train(docs: DataFrame, known: np.ndarray, number: np.ndarray, rounds: int = ROUNDS) -> net.Weights:
    """The network after ``rounds`` of averaging over all of (doc_id, text)."""
    context, weights = docs.sparkSession.sparkContext, net.initial()

    for _ in range(rounds):
        start = context.broadcast((weights, known, number))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            weights, known, number = start.value
            trainer = net.Trainer(weights)
            for batch in slices(batches):
                words = _words(batch)
                ids = numbered(words.hash, known, number)
                trainer.learn(ids, net.contexts(ids, words.doc))
            if trainer.seen:
                total = net.flat(trainer.w) * trainer.seen
                yield pa.RecordBatch.from_arrays([pa.array([trainer.seen]), pa.array([total.astype("<f4").tobytes()])], ["n", "total"])

        def both(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
            return a[0] + b[0], (np.frombuffer(a[1], "<f4") + np.frombuffer(b[1], "<f4")).tobytes()

        copies = docs.select("text").mapInArrow(run, "n long, total binary").rdd.map(lambda r: (r[0], bytes(r[1])))
        seen, total = copies.union(context.parallelize([(0, b"")], 1)).treeReduce(lambda a, b: a if not b[0] else b if not a[0] else both(a, b))
        if not seen:
            break
        weights = net.unflat(np.frombuffer(total, "<f4").astype(np.float64) / seen)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every text."""
    own = id_and_text(docs, id_col, text_col)
    counts = write_stage(word_counts(own))
    known, number, n_known = _most_frequent(counts)
    in_class, total = class_counts(counts, known, n_known)
    often, n_often = held_counts(counts, total, held)
    log_class = np.log(np.maximum(in_class, 1))
    sent = docs.sparkSession.sparkContext.broadcast((train(own, known, number, rounds), known, number, log_class, often, np.log(n_often)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, number, log_class, often, log_often = sent.value
        for batch in slices(batches):
            words = _words(batch)
            ids = numbered(words.hash, known, number)
            log_p = net.log_probabilities(weights, ids, net.contexts(ids, words.doc))
            classed = np.flatnonzero(ids > KNOWN)
            at, there = _found(words.hash[classed], often)
            log_p[classed] -= log_class[ids[classed] - KNOWN - 1]
            log_p[classed[there]] += log_often[at[there]]
            rest = classed[~there]
            rest = rest[np.lexsort((words.hash[rest], words.doc[rest]))]
            hashes, doc = words.hash[rest], words.doc[rest]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rest)), bool), (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(np.append(first, len(rest)))
            ends = pa.array(np.searchsorted(doc[first], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(hashes[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            total = np.bincount(words.doc, log_p, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(total), *lists], ["row", "doc_id", "n_words", "log_prob", "word", "times"])

    rows = write_stage(own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, n_words long, log_prob double, word array<long>, times array<long>"))
    rest = rows.select("row", F.explode(F.arrays_zip("word", "times")).alias("w")).select("row", "w.word", "w.times")
    shares = rest.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("rest"))
    log_prob = F.col("log_prob") + F.coalesce("rest", F.lit(0.0))
    return rows.select("row", "doc_id", "n_words", "log_prob").join(shares, "row", "left").select(
        "doc_id", "n_words", log_prob.alias("log_prob"), (log_prob / F.greatest("n_words", F.lit(1))).alias("mean_log_prob")
    )
