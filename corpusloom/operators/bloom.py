"""Bloom filters that grow, and the removal of repeated texts with them.

A filter never misses what was added; it takes something new for seen at about the error rate. So a repeated text
always goes, and a unique one goes with that probability. What is kept is 20 to 30 bits a key, not the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ERROR_RATE, CAPACITY = 1e-6, 1 << 14


class _Layer:
    """A filter of fixed size for ``capacity`` keys."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.held = capacity, 0
        self.probes = max(1, math.ceil(math.log2(1 / error)))
        bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
        self.bits = np.zeros((bits + 63) // 64, "u8")
        self.size = np.uint64(64 * len(self.bits))

    def _places(self, h: np.ndarray) -> np.ndarray:
        """probes x keys places by double hashing; the step is odd and mixed apart from the start."""
        step = (h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(31))) | np.uint64(1)
        return (h + np.arange(self.probes, dtype="u8")[:, None] * step) % self.size

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._places(h)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def put(self, h: np.ndarray) -> None:
        at = self._places(h).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        self.held += len(h)


class ScalableBloom:
    """Layers of doubling capacity and halving error, whose sum stays below ``error``. Keys are 64-bit hashes."""

    def __init__(self, capacity: int = CAPACITY, error: float = ERROR_RATE):
        self.error, self.layers = error, [_Layer(capacity, error / 2)]

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Add unsigned 64-bit hashes in order; for each, whether it was there before."""
        h, first = np.unique(keys, return_index=True)
        seen = np.ones(len(keys), bool)
        known = np.zeros(len(h), bool)
        for layer in self.layers:
            known |= layer.has(h)
        seen[first] = known
        new = h[~known]
        while len(new):
            last = self.layers[-1]
            room = last.capacity - last.held
            if room <= 0:
                self.layers.append(_Layer(2 * last.capacity, self.error / 2 ** (len(self.layers) + 1)))
                continue
            last.put(new[:room])
            new = new[room:]
        return seen


def unseen(rows: DataFrame, capacity: int = CAPACITY, error: float = ERROR_RATE) -> DataFrame:
    """Rows (id, h: a long) whose h was not met before in their partition, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ScalableBloom(capacity, error)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(~held.add(b.column("h").to_numpy().view("u8"))))

    return rows.mapInArrow(run, rows.schema)


def bloom_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, error: float = ERROR_RATE) -> DataFrame:
    """Documents whose text no document with a smaller id has, and (at about twice ``error``) a few such less.

    Every task first drops what it has met itself, in the order of ids, so a text that a third of all rows share leaves
    one row per task. The rest, an id and a hash each, is dealt out by hash and passes a second filter in that order.
    Null texts are texts of their own kind, equal to each other; ids should be distinct and not null.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    own = unseen(keyed.sortWithinPartitions("id"), capacity, error)
    kept = unseen(own.repartition("h").sortWithinPartitions("id"), capacity, error)
    return docs.join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi")
