"""Benchmark decontamination: which test items does a document contain?

An item is contained in a document if at least ``threshold`` of its distinct word shingles occur in the document.
The search is by MinHash, with sketches sized for containment and not for resemblance, so that a short item is found
in a document of any length. Items are partitioned by shingle width and by size in powers of two; each partition has an
index of its own with its own sketch length, and a document is looked up in every partition. With one hash function the
sketch of an item is its k least shingle hashes, and k follows from the upper size u of its partition: a document that
contains the item lacks at most u - ceil(threshold * u) of its shingles, so with one hash more than that in the sketch
at least one of them is among the document's. There are no false negatives, whatever the document's size. Candidates
are verified on the shingles themselves.

Five words are a shingle; an item of fewer words is a single shingle of all its words and is looked for at that width.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import rows, table, values
from corpusloom.llm.keys import fresh, text_of
from corpusloom.llm.words import shingles, words
from corpusloom.plans.storage import Stash

WIDTH, THRESHOLD = 5, 0.8
#: Bytes of item text up to which the index is broadcast. In memory an index takes some thirty times its text.
INDEX_BYTES = 4 << 20
#: Bits of the filter through which documents' shingle hashes pass before they are shuffled, at most.
FILTER_BITS = 1 << 26
_HITS = "doc_id long, item_id long, shared long, item_shingles long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in tokens], "u8")


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per shingle from those of its words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, "u8")
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out * _MIX


def allowed_missing(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9)


@dataclass
class Item:
    """A test item: its shingles of ``width`` words, and the upper size of its partition."""

    name: int | None
    width: int
    shingles: frozenset[bytes]

    @property
    def upper(self) -> int:
        return 1 << (len(self.shingles) - 1).bit_length()

    def missing(self, threshold: float) -> int:
        return allowed_missing(len(self.shingles), threshold)


def item_of(name: int | None, text: str | None, width: int = WIDTH) -> Item | None:
    tokens = words(text)
    if not tokens:
        return None
    w = min(width, len(tokens))
    return Item(name, w, frozenset(shingles(tokens, w)))


def sketch(text: str | None, width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[int, int, np.ndarray]:
    """Of an item's text: shingle width, upper size of its partition, and its sketch. No words: width 0."""
    item = item_of(None, text, width)
    if item is None:
        return 0, 0, np.zeros(0, "u8")
    k = allowed_missing(item.upper, threshold) + 1
    return item.width, item.upper, np.unique(shingle_hashes(word_hashes(words(text)), item.width))[:k]


class Items:
    """Test items with an index of their sketches for each partition (shingle width, upper size)."""

    def __init__(self, named: list[tuple[int | None, str | None]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.threshold, self.items = threshold, []
        entries: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for name, text in named:
            item = item_of(name, text, width)
            if item is None:
                continue
            w, upper, hashes = sketch(text, width, threshold)
            entries[w, upper] += [(h, len(self.items)) for h in hashes.tolist()]
            self.items.append(item)
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for (w, _), pairs in sorted(entries.items()):
            pairs.sort()
            self.index[w].append((np.array([h for h, _ in pairs], "u8"), np.array([i for _, i in pairs], "i8")))
        self.every = {w: np.unique(np.concatenate([keys for keys, _ in parts])) for w, parts in self.index.items()}

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a sketch hash with the document of these word hashes."""
        out: set[int] = set()
        for w, parts in self.index.items():
            h = shingle_hashes(hashes, w)
            known = self.every[w]
            hit = np.unique(h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h])
            if not len(hit):
                continue
            for keys, items in parts:
                for lo, hi in zip(np.searchsorted(keys, hit), np.searchsorted(keys, hit, side="right"), strict=True):
                    out.update(items[lo:hi].tolist())
        return out

    def hits(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """``(item, shingles shared, shingles of the item)`` of each item that the text contains."""
        tokens = words(text)
        found = [self.items[i] for i in sorted(self.candidates(word_hashes(tokens)))] if tokens else []
        own = {w: set(shingles(tokens, w)) for w in {x.width for x in found}}
        shared = [(x, len(x.shingles & own[x.width])) for x in found]
        return [(x.name, n, len(x.shingles)) for x, n in shared if len(x.shingles) - n <= x.missing(self.threshold)]


_HIT_NAMES, _HIT_KINDS = ("doc_id", "item_id", "shared", "item_shingles"), (pa.int64(),) * 4


def _texts(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("item_text")).where("item_text != ''")


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0


def _index(items: DataFrame, width: int, threshold: float) -> Broadcast:
    """Of items whose texts are known to be within the bound."""
    named = [(r.item_id, r.item_text) for r in items.orderBy("item_id", "item_text").collect()]
    return items.sparkSession.sparkContext.broadcast(Items(named, width, threshold))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """A row per document and item that it contains: doc_id, item_id, shared, item_shingles, containment.

    Items whose texts make up at most ``index_bytes`` are sent to all executors and the documents are scanned once,
    without a shuffle; more items are joined to the documents by shingle hash. Null and empty texts contain nothing
    and are contained in nothing. Repeated rows give repeated results; null ids stay null. With an empty table on
    either side the result is empty. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    items = _texts(items, item_id, item_text)
    if _bytes(items) <= index_bytes:
        shared = _index(items, width, threshold)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield table([(doc, *hit) for doc, text in rows(b, 0, 1) for hit in shared.value.hits(text)], _HIT_NAMES, _HIT_KINDS)

        hits = docs.mapInArrow(scan, _HITS)
    else:
        hits = _joined(docs, items, width, threshold)
    return hits.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def _filter_bits(sketches: DataFrame) -> Broadcast:
    """A bit for each place that a sketch hash takes: sixteen places per hash, ``FILTER_BITS`` at most. What passes is
    joined on the hash itself, so a full filter costs time and no result."""
    n = sketches.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    held = sketches.groupBy(F.shiftright(place, 5).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 32, "u4")  # 8 MiB at most, and as many rows were gathered as it has words
    out[held["at"].to_numpy("i8")] = held["bits"].to_numpy("i8")
    return sketches.sparkSession.sparkContext.broadcast(out)


def _joined(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """The search for any number of items: sketches and documents meet by partition of items and shingle hash,
    candidates are then verified. Items of equal texts are one, so copies of an item make no pairs."""
    names, kinds = ("item", "w", "upper", "h"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for item, text in rows(b, "item", "item_text"):
                w, upper, hashes = sketch(text, width, threshold)
                found += [(item, w, upper, h) for h in hashes.view("i8").tolist()]
            yield table(found, names, kinds)

    texts = Stash(items.groupBy("item_text").agg(F.min("item_id").alias("first")).select("item_text").withColumn("item", F.monotonically_increasing_id()), "items").df
    sketches = Stash(texts.mapInArrow(sketched, "item long, w int, upper long, h long"), "sketches").df
    widths = sorted(r.w for r in sketches.select("w").distinct().collect())  # at most ``width`` numbers
    passing = _filter_bits(sketches)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        last = np.uint64(32 * len(bits) - 1)
        held: list[tuple[int, int, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            sizes = [len(h) for _, _, h in held]
            columns = (np.repeat([doc for doc, _, _ in held], sizes), np.repeat([w for _, w, _ in held], sizes).astype("i4"), np.concatenate([h for _, _, h in held]).view("i8"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "w", "h"])

        for b in batches:
            for doc, text in rows(b, "doc", "text"):
                hashes = word_hashes(words(text))
                for w in widths:
                    h = np.unique(shingle_hashes(hashes, w))
                    at = h & last
                    h = h[(bits[(at >> np.uint64(5)).astype("i8")] >> (h & np.uint64(31)).astype("u4")) & np.uint32(1) == 1]
                    if len(h):
                        held.append((doc, w, h))
                if sum(len(h) for _, _, h in held[-64:]) > 1 << 16 or len(held) >= 1 << 14:
                    yield flushed()
        if held:
            yield flushed()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1024)(lambda text: item_of(None, text, width))
        for b in batches:
            found = []
            for doc, text, item, item_text in rows(b, "doc", "text", "item", "item_text", step=16):
                x = known(item_text)
                shared = len(x.shingles.intersection(shingles(words(text), x.width)))
                if len(x.shingles) - shared <= x.missing(threshold):
                    found.append((doc, item, shared, len(x.shingles)))
            yield table(found, ("doc", "item", "shared", "item_shingles"), _HIT_KINDS)

    docs = Stash(docs.withColumn("doc", F.monotonically_increasing_id()), "docs").df
    hashes = Stash(docs.select("doc", "text").where("text != ''").mapInArrow(own, "doc long, w int, h long"), "hashes").df
    pairs = Stash(hashes.join(sketches, ["w", "h"]).select("doc", "item").distinct(), "candidates").df
    both = pairs.join(docs.select("doc", "text"), "doc").join(texts, "item")
    good = Stash(both.select("doc", "text", "item", "item_text").mapInArrow(verify, "doc long, item long, shared long, item_shingles long"), "verified").df
    named = items.join(texts, "item_text").select("item", "item_id")
    return good.join(docs.select("doc", "doc_id"), "doc").join(named, "item").select("doc_id", "item_id", "shared", "item_shingles")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay as they are.

    Each row is judged by its own text, so rows that share an id (or have none) go or stay apart, and repeated rows
    alike. Null and empty texts contain nothing and stay; null and empty items are ignored. With an empty table on
    either side all rows of ``docs`` stay. Columns of any name may be there.
    """
    items = _texts(items.withColumn("item_id", F.lit(0)).select("item_id", item_text), "item_id", item_text)
    if _bytes(items) > index_bytes:
        row = fresh(docs, "__row")
        held = Stash(docs.withColumn(row, F.monotonically_increasing_id()), "docs").df
        hit = contained_items(held, items, row, text_col, "item_id", "item_text", width, threshold, index_bytes)
        return held.join(hit.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)
    shared = _index(items, width, threshold)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.hits(t) for t in values(b.column(text_col))], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
