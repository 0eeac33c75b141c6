"""Token counts with overlap resynchronisation for huge documents.

A text over ``chunk`` characters is encoded in chunks that overlap; each chunk
gives its tokens' offsets. Two neighbours are spliced at a common boundary in
the overlap that is proven stable: both start a token there and the character
before is white space, which the tokenizer drops and no token or normalization
spans. Where the overlap holds no such place (no white space, or the left end
cut a word), it is widened, doubling until it aligns or reaches the end. Other
texts are counted unit by unit, with a bounded memo per Python worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id
stays null; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.texts import KEPT, UNIT_SLICE_BYTES, Memo, id_and_text, slices
from taxaledger.llm.wordpiece_units import WordTokenizer, units

CHUNK = 32_768
OVERLAP = 512
MEMO_UNITS = 300_000

#: White space to every library.
_SPACE = " \t\n\r"


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo_units: int = MEMO_UNITS):
        self.tokenizer, self.chunk, self.overlap = WordTokenizer(path), chunk, overlap
        self.memo = Memo(self.unit_counts, memo_units)

    def unit_counts(self, new: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.whole.encode_batch_fast(new, add_special_tokens=False)]

    def starts(self, text: str, left: int, right: int) -> list[int]:
        """Where the tokens of ``text[left:right]`` start in the text."""
        return [left + a for a, _ in self.tokenizer.whole.encode(text[left:right], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """Tokens of ``text``, from overlapping chunks."""
        total, begin, left, right = 0, 0, 0, min(len(text), self.chunk)
        here = self.starts(text, left, right)
        while right < len(text):
            overlap, seam = self.overlap, None
            while seam is None:
                next_left, next_right = max(left, right - overlap), min(len(text), right - overlap + max(self.chunk, 2 * overlap))
                there = self.starts(text, next_left, next_right)
                both = set(here)
                seam = next((p for p in there if max(begin, next_left) < p < right and text[p - 1] in _SPACE and p in both), None)
                if seam is None:
                    if next_left == left:  # the whole chunk holds no seam: take it longer
                        if next_right <= right:
                            next_right = min(len(text), right + (right - left))
                        right, here = next_right, self.starts(text, left, next_right)
                        if right == len(text):
                            return total + sum(p >= begin for p in here)
                        overlap = self.overlap
                    else:
                        overlap *= 2
            total += sum(begin <= p < seam for p in here)
            begin, left, right, here = seam, next_left, next_right, there
        return total + sum(p >= begin for p in here)

    def count_batch(self, texts: list[str | None]) -> list[int]:
        parts = [None if t and len(t) > self.chunk else units(t) for t in texts]
        self.memo.learn(p for p in parts if p)
        known = self.memo.__getitem__
        return [self.spliced(t) if p is None else sum(map(known, p)) for p, t in zip(parts, texts, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


KEPT.append(counter.cache_clear)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path, chunk, overlap)
        for batch in slices(batches, most=UNIT_SLICE_BYTES):
            text = batch.column("text")
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            n_tokens = pa.array(c.count_batch(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
