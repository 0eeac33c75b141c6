"""Shared helpers: reading tables, bounded Arrow slices, whitespace-unit memos."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark has a Python worker for each core: the tokenizers library must not start threads of its own.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Bytes of text that one Python step holds at once, unless a single text is longer.
#: Hashing takes some thirty times that in arrays.
SLICE_BYTES = 1 << 20

#: The same for steps that learn the units of a slice together.
UNIT_SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Clears what a tokenizer operator keeps in a Python worker.
KEPT: list[Callable[[], None]] = []


def release(kept: bool = True) -> None:
    """Give free memory back to the system, and with ``kept`` that of kept tokenizers and memos.

    Spark uses a Python worker again for other operators; the executor's limit
    counts what the last one left in it.
    """
    if kept:
        for clear in KEPT:
            clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column`` (or one row)."""
    release(kept=most != UNIT_SLICE_BYTES)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


class Memo(dict):
    """A bounded map from short strings to their encodings, filled in batches.

    ``encode`` takes a list of strings. A map over its bound drops all that the
    batch at hand does not use. Strings over ``longest`` characters are dropped
    after their batch.
    """

    def __init__(self, encode: Callable[[list[str]], list], bound: int, longest: int = 64):
        super().__init__()
        self.encode, self.bound, self.longest, self.long = encode, bound, longest, []

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Afterwards the map holds each string of ``lists``."""
        for key in self.long:
            del self[key]
        used = set(chain.from_iterable(lists))
        new = list(used.difference(self))
        if len(self) + len(new) > self.bound:
            kept = {k: self[k] for k in used if k in self}
            self.clear()
            self.update(kept)
        self.update(zip(new, self.encode(new), strict=True))
        self.long = [k for k in new if len(k) > self.longest]
