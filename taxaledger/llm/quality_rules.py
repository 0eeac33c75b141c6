"""Rules on repetition and length, and the divergence of a text from known languages.

A first pass adds up, for each language, the character classes and the words of
all its documents that pass the base rules. A language's references are its
histogram of character classes and that of its ``COMMON`` most frequent words
with one more class for all other words. A document's own histograms are held
against each language's: it is kept if some language is near in both. Nearness
is the Jensen-Shannon distance to base 2 (0: equal, 1: nothing in common). Short
texts have noisy histograms, so each test has a least length under which it
passes every text. The language of a document is not used in its verdict.

Defined results: null and empty texts have no words and fail the base rules.
A document without language counts for no reference. Languages beyond the
``LANGUAGES`` with the most passing documents (ties by name) have no reference;
that bounds what is sent to the tasks. Without any reference the base rules
decide alone. Equal counts of words are ordered by the word. Null and equal
doc_ids are ordinary rows; other columns are not read; an empty table gives an
empty result. A text longer than a slice is a slice of its own, held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaledger.llm.texts import slices
from taxaledger.llm.word_measures import CLASSES, Measures
from taxaledger.session import write_stage

#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

#: Frequent words of a language's reference.
COMMON = 64
LANGUAGES = 256

#: Largest distances, and the least length (characters, words) from which they count.
CLASS_DISTANCE, CLASS_LEAST = 0.25, 250
WORD_DISTANCE, WORD_LEAST = 0.37, 100


@dataclass(frozen=True)
class Reference:
    """``classes``: shares of the character classes; ``words``: the frequent words and their shares, the last share for all others."""

    lang: str
    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col) if lang_col else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _language_counts(docs: DataFrame) -> DataFrame:
    """(lang, class, word, n): class counts where ``word`` is null, document counts where both are. Counted in each slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = Measures(_bytes(batch))
            passed = ~base_failed(m.n_words, m.n_repeat_words)
            names = batch.column("lang").to_pylist()
            langs = sorted({x for x, ok in zip(names, passed.tolist(), strict=True) if ok and x is not None})
            index = {x: i for i, x in enumerate(langs)}
            of_text = np.array([index[x] if ok and x is not None else -1 for x, ok in zip(names, passed.tolist(), strict=True)], np.int64)
            of_word = of_text[m.text]
            size = max(1, len(m.known))
            cells, counts = np.unique((of_word * size + m.number)[of_word >= 0], return_counts=True)
            words = list(m.known)
            rows = [(langs[c // size], None, words[c % size], n) for c, n in zip(cells.tolist(), counts.tolist(), strict=True)]
            for i, lang in enumerate(langs):
                own = of_text == i
                rows.append((lang, None, None, int(own.sum())))
                rows += [(lang, c, None, n) for c, n in enumerate(m.classes[own].sum(axis=0).tolist())]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64())],
                ["lang", "class", "word", "n"],
            )

    return docs.mapInArrow(run, "lang string, class int, word string, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON, languages: int = LANGUAGES) -> list[Reference]:
    """The references of the languages in ``docs``; at most ``languages * (common + 9)`` rows reach the driver."""
    counts = write_stage(_language_counts(_texts(docs, id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull())))
    words, classes = counts.filter("word is not null"), counts.filter("word is null and class is not null")
    chosen = [r["lang"] for r in counts.filter("word is null and class is null").orderBy(F.desc("n"), "lang").limit(languages).collect()]
    if not chosen:
        return []
    here = F.col("lang").isin(chosen)
    # The row limit is worked out in each task first: no task gets all words of a language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top, whole, by_class = {}, {}, {}
    for r in words.filter(here).select("lang", "word", "n", place.alias("place")).filter(F.col("place") <= common).orderBy("lang", "place").collect():
        top.setdefault(r["lang"], []).append((r["word"].encode(), r["n"]))
    for r in words.filter(here).groupBy("lang").agg(F.sum("n").alias("n")).collect():
        whole[r["lang"]] = r["n"]
    for r in classes.filter(here).collect():
        by_class.setdefault(r["lang"], np.zeros(len(CLASSES)))[r["class"]] = r["n"]
    out = []
    for lang in sorted(chosen):
        n = np.array([x for _, x in top[lang]], np.float64)
        shares = np.concatenate((n, [whole[lang] - n.sum()])) / whole[lang]
        out.append(Reference(lang, by_class[lang] / by_class[lang].sum(), [w for w, _ in top[lang]], shares))
    return out


def divergence(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance to base 2 of each row of counts to one distribution."""
    p = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        other = np.where(shares > 0, shares * np.log2(shares / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (own + other) / 2))


def near_some_language(m: Measures, refs: list[Reference]) -> np.ndarray:
    """Whether each text is near a reference in both histograms, as far as its length lets them count."""
    size = len(m.n_words)
    if not refs:
        return np.ones(size, bool)
    every = {w: i for i, w in enumerate(dict.fromkeys(w for r in refs for w in r.words))}
    place = np.fromiter((every.get(w, len(every)) for w in m.known), np.int64, len(m.known))
    k = len(every) + 1
    counts = np.bincount(m.text * k + place[m.number], minlength=size * k).reshape(size, k)
    chars = m.classes.sum(axis=1)
    near = np.zeros(size, bool)
    for r in refs:
        own = counts[:, [every[w] for w in r.words]]
        words = np.concatenate((own, (m.n_words - own.sum(axis=1))[:, None]), axis=1)
        by_class = (divergence(m.classes, r.classes) <= CLASS_DISTANCE) | (chars < CLASS_LEAST)
        near |= by_class & ((divergence(words, r.shares) <= WORD_DISTANCE) | (m.n_words < WORD_LEAST))
    return near


def judge(docs: DataFrame, refs: list[Reference], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and the verdict of every row."""
    held = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = Measures(_bytes(batch))
            failed = base_failed(m.n_words, m.n_repeat_words)
            kept = ~failed & near_some_language(m, held.value)
            numbers = [pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(failed), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return _texts(docs, id_col, text_col, None).mapInArrow(run, schema)


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs, references(docs))
