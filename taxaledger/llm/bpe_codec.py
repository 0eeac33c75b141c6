"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Texts are encoded where they lie (no shuffle), see ``segment_tree``. A bounded
memo per Python worker keeps the ids of short units, as most words recur.

Defined results: a null or empty text has no ids and decodes to the empty text;
a null doc_id stays null; repeated rows are encoded each; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxaledger.llm.segment_tree import SegmentTreeBpe
from taxaledger.llm.texts import KEPT, UNIT_SLICE_BYTES, Memo, id_and_text, slices
from taxaledger.llm.wordpiece_units import WordTokenizer, byte_letters, units

#: Units whose ids a Python worker keeps.
MEMO_UNITS = 300_000


class Codec:
    """Texts to ids (as decimal strings, joined by a space) and back."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        self.tokenizer = t = WordTokenizer(path)
        self.bpe = SegmentTreeBpe(t.spec["vocab"], t.spec["merges"], t.spec["end_of_word_suffix"], byte_letters())
        names = {i: s for s, i in t.spec["vocab"].items()} | {i: s for s, i in t.special.items()}
        self.name = {str(i): s for i, s in names.items()}
        self.digits = [str(i) for i in range(max(names) + 1)]
        self.memo = Memo(lambda new: self.ids_of(t.unit_pieces(new)), memo_units)

    def ids_of(self, lists: list[list[bytes | int]]) -> list[str]:
        """The joined ids of each list of pieces."""
        pieces = [p for ps in lists for p in ps if p.__class__ is bytes]
        ids, ends = [], [0]
        if pieces:
            found, counts = self.bpe.encode(pieces)
            ids, ends = list(map(self.digits.__getitem__, found.tolist())), [0, *np.cumsum(counts).tolist()]
        out, at = [], 0
        for ps in lists:
            if all(p.__class__ is bytes for p in ps):
                out.append(" ".join(ids[ends[at] : ends[at + len(ps)]]))
                at += len(ps)
                continue
            said = []
            for p in ps:
                if p.__class__ is int:
                    said.append(self.digits[p])
                else:
                    said += ids[ends[at] : ends[at + 1]]
                    at += 1
            out.append(" ".join(said))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[str]:
        parts = [units(t) for t in texts]
        self.memo.learn(p for p in parts if p)
        known = self.memo.__getitem__
        return [" ".join(map(known, p)) if p is not None else self.ids_of([self.tokenizer.pieces(t)])[0] for p, t in zip(parts, texts, strict=True)]

    def encode(self, text: str | None) -> str:
        return self.encode_batch([text])[0]

    def decode(self, ids: str) -> str:
        """As the library decodes without a decoder: token strings joined by a space."""
        return " ".join(map(self.name.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


KEPT.append(codec.cache_clear)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in slices(batches, most=UNIT_SLICE_BYTES):
            ids = [list(map(int, said.split())) for said in c.encode_batch(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            texts = [c.decode(" ".join(map(str, ids or []))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and digest of each text's ids, and the digest of what they decode to.

    Encoding and decoding meet in one step: ids of all documents are several
    times the size of the texts, and neither side needs other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches, most=UNIT_SLICE_BYTES):
            counts, ids_sha, text_sha = [], [], []
            for ids in c.encode_batch(batch.column("text").to_pylist()):
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                text_sha.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
