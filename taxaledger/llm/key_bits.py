"""A set of 64-bit hashes as a bit array of fixed size, for filters before a shuffle.

It can hold a hash that was never put in, never miss one that was. Its size is
fixed, so it can be sent everywhere; beyond its capacity it filters less, and
what follows it still decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 2 MB: under one false hit in a hundred up to about a million hashes.
BITS = 24


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def collect_bits(hashes: DataFrame) -> bytes:
    """The bits of the one (long) column; each task sends at most ``2**BITS`` bits, joined in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                bits[at] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    def either(a: bytes, b: bytes) -> bytes:
        return np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()

    parts = hashes.mapInArrow(run, "bits binary").rdd.map(lambda r: bytes(r[0]))
    return parts.fold(bytes(1 << (BITS - 3)), either) if parts.getNumPartitions() < 2 else parts.treeReduce(either)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes that may be in the set; ``bits`` as unpacked booleans."""
    a, b = _places(hashes)
    return bits[a] & bits[b]


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
