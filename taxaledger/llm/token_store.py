"""Token ids as bit- or byte-plane shuffled blocks with a chunk index.

**Format.** A store is a folder with two Parquet tables. ``blocks``: one row per
block of ``BLOCK_IDS`` ids (the last of a shard may be shorter): shard, block,
first (place of its first id in the shard), n_ids, planes and docs. The ids of
a block, unsigned 32-bit little-endian, are transposed into 32 bit planes or 4
byte planes, each compressed with zstandard on its own. ``docs`` lists the
document pieces in the block: place of the document in the shard, doc_id, start
in the block, number of ids. ``index`` is the chunk index: shard, block, first,
n_ids and the compressed bytes of each plane. Shards are ranges of doc_id in
ascending order, so shard by shard the ids are in document order. Spark's own
writer commits the files, so a lost executor or a repeated task leaves no half
block, on any file system that Spark reaches.

**Bounded memory.** A writer holds one slice of texts and one block; a reader
decodes one block at a time. A document over several blocks has a piece in
each; the checksum of the whole is combined from those of its pieces.

Defined results: a null or empty text has only the end id; null doc_ids come
first; equal doc_ids are separate documents in any order among themselves;
other columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxaledger.llm.texts import KEPT, UNIT_SLICE_BYTES, Memo, id_and_text, slices
from taxaledger.llm.wordpiece_units import BEYOND, byte_letters, latin

BLOCK_IDS = 1 << 16
LEVEL = 3
MEMO_UNITS = 300_000

_DOCS = "array<struct<place: long, doc_id: long, at: int, n: int>>"
BLOCKS_SCHEMA = f"shard int, block int, first long, n_ids int, planes array<binary>, docs {_DOCS}"
PIECES_SCHEMA = "shard int, place long, doc_id long, first long, n long, crc long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of ids, most significant last."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = rows.T
    elif kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
    else:
        raise ValueError(f"no such kind of plane: {kind}")
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of a block; the number of planes tells their kind."""
    unpacker = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpacker.decompress(p), np.uint8) for p in planes]
    if len(rows) == 32:
        bits = np.unpackbits(np.stack(rows), axis=1, count=n_ids)
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(np.stack(rows, axis=1) if isinstance(rows, list) else rows.T).view("<u4").reshape(-1)


#: Fixed value: the byte-level pattern, for characters below BEYOND.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(L=latin("L"), N=latin("N"), S=r"\t-\r\x20\x85\xa0"))

LETTERS = str.maketrans(dict(enumerate(byte_letters())))


class ByteTokenizer:
    """The library's byte-level tokenizer, asked once for each short unit.

    A space before a character that is not white space always starts a new
    piece of the tokenizer's pattern, so the ids of a text are those of its
    parts split there. Characters that libraries class differently as white
    space are no such place. Other tokenizers get whole texts.
    """

    _SPLIT = re.compile("[ ](?![\\s\x1c-\x1f\x85\u180e\u200b\ufeff]|\\Z)")
    _DOUBT = re.compile("[ ](?:[\\s\x1c-\x1f\x85\u180e\u200b\ufeff]|\\Z)")

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        self.whole = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        self.by_unit = t.normalizer is None and type(t.pre_tokenizer).__name__ == "ByteLevel" and not t.pre_tokenizer.add_prefix_space and not any(" " in a for a in added)
        self.model, self.has_added = t.model, re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.first = Memo(lambda new: [self._encode_unit(u) if u else b"" for u in new], memo_units // 8)
        self.rest = Memo(lambda new: [self._encode_unit(" " + u) for u in new], memo_units)

    def _encode_unit(self, unit: str) -> bytes:
        """Units of Latin letters: the library's model on pieces split here; others: the whole library."""
        if max(unit) >= BEYOND or self.has_added(unit):
            return self._encode([unit])[0]
        tokenize = self.model.tokenize
        return array("I", [t.id for p in PIECES.findall(unit) for t in tokenize(p.encode().decode("latin-1").translate(LETTERS))]).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit integers."""
        if not self.by_unit:
            return self._encode([t or "" for t in texts])
        parts = [self._SPLIT.split(t) if self._DOUBT.search(t) else t.split(" ") for t in (t or "" for t in texts)]
        self.first.learn([p[0]] for p in parts)
        self.rest.learn(p[1:] for p in parts)
        first, rest = self.first, self.rest.__getitem__
        return [first[p[0]] + b"".join(map(rest, p[1:])) for p in parts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


KEPT.append(tokenizer.cache_clear)


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 0, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of ``blocks``: one range shuffle of the texts, then one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, pieces, filled = [], [], 0
        place = block = first = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, pieces, filled, block, first
            row = {"shard": shard, "block": block, "first": first, "n_ids": filled, "planes": to_planes(np.concatenate(held), kind), "docs": pieces}
            block, first = block + 1, first + filled
            held, pieces, filled = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow())

        for batch in slices(batches, most=UNIT_SLICE_BYTES):
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, raw in zip(doc_ids, tok.encode_batch(batch.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, block_ids - filled)
                    held.append(ids[at : at + n])
                    pieces.append({"place": place, "doc_id": doc_id, "at": filled, "n": n})
                    at, filled = at + n, filled + n
                    if filled == block_ids:
                        yield flush()
                place += 1
        if filled:
            yield flush()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, BLOCKS_SCHEMA)


def _arrow() -> pa.Schema:
    piece = pa.struct([("place", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(piece))])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Write both tables of the store."""
    spark = docs.sparkSession
    encode_blocks(docs, tokenizer_path, **options).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks")
    blocks.select("shard", "block", "first", "n_ids", F.transform("planes", F.octet_length).alias("plane_bytes")).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, place, doc_id, first, ids array<long>): each document piece of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _blocks(batches):
            docs = row["docs"]
            yield pa.RecordBatch.from_pydict(
                {"shard": [row["shard"]] * len(docs), "place": [d["place"] for d in docs], "doc_id": pa.array([d["doc_id"] for d in docs], pa.int64()), "first": [row["first"] + d["at"] for d in docs], "ids": [ids[d["at"] : d["at"] + d["n"]].astype(np.int64) for d in docs]},
                schema=pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]),
            )

    return spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, "shard int, place long, doc_id long, first long, ids array<long>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, from_planes(row["planes"], row["n_ids"])


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=None)
def _zero_bits(power: int) -> list[int]:
    """What appending ``2**power`` zero bits does to each bit of a checksum."""
    if power == 0:
        return [0xEDB88320, *(1 << i for i in range(31))]
    half = _zero_bits(power - 1)
    return [_times(half, row) for row in half]


def crc32_joined(crc: int, more: int, n_bytes: int) -> int:
    """The checksum of two byte strings in a row, from theirs and the second's length."""
    n_bits, power = n_bytes * 8, 0
    while n_bits:
        if n_bits & 1:
            crc = _times(_zero_bits(power), crc)
        n_bits, power = n_bits >> 1, power + 1
    return crc ^ more


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _blocks(batches):
            docs, raw = row["docs"], memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(docs), pa.int32()),
                    pa.array([d["place"] for d in docs], pa.int64()),
                    pa.array([d["doc_id"] for d in docs], pa.int64()),
                    pa.array([row["first"] + d["at"] for d in docs], pa.int64()),
                    pa.array([d["n"] for d in docs], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * d["at"] : 4 * (d["at"] + d["n"])]) for d in docs], pa.int64()),
                ],
                ["shard", "place", "doc_id", "first", "n", "crc"],
            )

    @F.udf("long")
    def joined(pieces):
        if pieces is None:  # one piece: nothing to join
            return None
        crc = pieces[0]["crc"]
        for p in pieces[1:]:
            crc = crc32_joined(crc, p["crc"], 4 * p["n"])
        return crc

    pieces = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, PIECES_SCHEMA)
    documents = pieces.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("pieces"),
    )
    # Nearly all documents have one piece; only the others' pieces go to Python.
    several = F.when(F.size("pieces") > 1, F.col("pieces"))
    checksum = F.coalesce(joined(several), F.col("pieces")[0]["crc"])
    # One row per shard: as few as there are partitions.
    totals = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return documents.join(before, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", checksum.alias("ids_crc32"))
