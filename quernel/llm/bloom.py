"""A Bloom filter of a column of longs that tasks probe in numpy; it only ever saves work, an exact join decides.

What is broadcast has at most ``2 ** MOST_BITS`` bits. Where these would be fewer than LEAST_BITS for each id, a filter would let
nearly everything pass: none is built then, every row goes to the exact join, and the cost stays linear in the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import arrow_text as at

MOST_BITS = 27  # at most 2 ** 27 bits (16 MB) are broadcast, whatever the input
LEAST_BITS = 4  # for each id, below which a filter isn't worth its cost
PARTIALS = 32
SEGMENT_BITS = 20  # partial filters are merged in segments of so many bits, each in a task of its own


class Bloom:
    def __init__(self, bits: int, words: np.ndarray | None = None, full: bool = False):
        self.bits, self.full = bits, full  # full: everything passes
        self.words = np.zeros(1 << (bits - 3), dtype=np.uint8) if words is None else words

    def _slots(self, ids: np.ndarray):
        h = at.mix(ids.astype(np.int64, copy=False).view(np.uint64))
        for shift in (0, 18, 36):
            yield ((h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        for slot in self._slots(ids):
            np.bitwise_or.at(self.words, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        hit = np.ones(len(ids), dtype=bool)
        if not self.full:
            for slot in self._slots(ids):
                hit &= (self.words[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return hit

    def is_empty(self) -> bool:
        return not self.full and not self.words.any()


def build(ids: DataFrame) -> Bloom:
    """A filter of about 12 bits for each of the (materialized) ids, up to MOST_BITS."""
    count = ids.count()
    if count * LEAST_BITS > 1 << MOST_BITS:
        return Bloom(3, full=True)
    bits = min(MOST_BITS, max(13, int(12 * max(count, 1)).bit_length()))
    segment = 1 << (min(bits, SEGMENT_BITS) - 3)

    def partial(batches):
        bloom = Bloom(bits)
        for batch in batches:
            bloom.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        for first in range(0, len(bloom.words), segment):
            words = bloom.words[first : first + segment]
            if words.any():
                yield pa.RecordBatch.from_arrays([pa.array([first // segment], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["part", "words"])

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = np.frombuffer(words.as_buffer(), np.uint8)
                merged[part] = merged[part] | words if part in merged else words.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([w.tobytes() for w in merged.values()], pa.binary())], ["part", "words"])

    parts = ids.coalesce(PARTIALS).mapInArrow(partial, "part int, words binary")
    bloom = Bloom(bits)
    for row in parts.repartition(max(1, len(bloom.words) // segment), "part").mapInArrow(merge, "part int, words binary").collect():  # 16 MB at most
        bloom.words[row["part"] * segment : (row["part"] + 1) * segment] = np.frombuffer(row["words"], np.uint8)
    return bloom


def may_hold(ids: DataFrame):
    """A function of a column of longs: whether the (materialized) ids may hold it."""
    bloom = ids.sparkSession.sparkContext.broadcast(build(ids))

    @F.arrow_udf("boolean")
    def found(column: pa.Array) -> pa.Array:
        return pa.array(bloom.value.may_hold(column.fill_null(-1).to_numpy(zero_copy_only=False)))

    return found
