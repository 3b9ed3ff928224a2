"""Filters over 64-bit hashes: bit sets of bounded size that let through all values put in, and few others.

A value sets four bits of one 64-bit word; the top bits of the value choose the word. With BITS_EACH bits a value about one other
value in a hundred passes. Values beyond the capacity of one filter are split into ranges by bits that the filter does not use,
each with a filter of its own. The words are put together by Spark in segments of a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value at least, and bits of a filter at most (64 MB).
BITS_EACH, MOST_BITS = 12, 1 << 29
#: Words of a segment.
SEGMENT = 1 << 17

_ONE, _63 = np.uint64(1), np.uint64(63)


def ranges_for(n: int) -> int:
    """How many filters `n` values need."""
    return max(1, -(-n * BITS_EACH // MOST_BITS))


def in_range(h: Column, r: int, ranges: int) -> Column:
    return F.lit(True) if ranges == 1 else F.shiftrightunsigned(h, 24).bitwiseAND(0xFFFF) % ranges == r


def _log2(x: int) -> int:
    return x.bit_length() - 1


def build(hashes: DataFrame, n: int) -> Broadcast:
    """The filter of the `n` values in column `h`, sent to all executors: words of 64 bits, at most MOST_BITS bits."""
    words = 1 << 10
    while words * 64 < min(BITS_EACH * n, MOST_BITS):
        words *= 2
    part = min(words, SEGMENT)
    shift, inside = np.uint64(64 - _log2(words)), part - 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            word = (h >> shift).astype(np.int64)
            bits = _ONE << (h & _63)
            for k in (6, 12, 18):
                bits |= _ONE << (h >> np.uint64(k) & _63)
            segment = word // part
            for s in np.unique(segment).tolist():
                mine = segment == s
                np.bitwise_or.at(held.setdefault(s, np.zeros(part, np.uint64)), word[mine] & inside, bits[mine])
        for s, w in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([w.tobytes()])], ["segment", "bits"])

    segments = words // part
    where = F.shiftrightunsigned("h", 64 - _log2(segments)) if segments > 1 else F.lit(0).cast("long")
    out = np.zeros(words, np.uint64)
    for r in hashes.select("h", where.alias("s")).repartition(segments, "s").select("h").mapInArrow(fill, "segment long, bits binary").collect():
        out[r.segment * part : (r.segment + 1) * part] = np.frombuffer(r.bits, np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def passes(words: np.ndarray, h: np.ndarray, r: int = 0, ranges: int = 1) -> np.ndarray:
    """The places of the values in `h` that pass the filter of range `r`."""
    word = words[(h >> np.uint64(64 - _log2(len(words)))).astype(np.int64)]
    hit = np.flatnonzero(word >> (h & _63) & _ONE)
    for k in (6, 12, 18):
        hit = hit[(word[hit] >> (h[hit] >> np.uint64(k) & _63) & _ONE).astype(bool)]
    return hit if ranges == 1 else hit[(h[hit] >> np.uint64(24) & np.uint64(0xFFFF)) % np.uint64(ranges) == r]
