"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's tokens (with the end id) are cut only if they exceed a sequence; the first piece then holds the remainder
and the others are full. The rest is bin packing of integer lengths, planned on the histogram of lengths alone:

1. exact complements: the sums of single lengths, pairs and triples are indexed; combinations that fill a sequence to
   the last token are consumed, as often as the counts of their lengths allow, longest length first;
2. what is left is placed by best fit, longest first, into the smallest open gap that holds it.

Both work on counts, so a step places any number of equal items at once and the plan depends on the sequence length,
not on the corpus. Rows then learn their place from their rank among the pieces of their length. The tokens are not
shuffled at all, only a row of integers per piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import rows, table
from corpusloom.llm.keys import text_of
from corpusloom.llm.tokens import encoder
from corpusloom.plans.ordering import numbered_within
from corpusloom.plans.storage import Stash

CAPACITY, END = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, control_text: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. ``control_text``: see ``llm.tokens``."""

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True, control_text).encode
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            found = []
            for doc, text in rows(b, 0, 1):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    found.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            yield table(found, names, kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, how many sequences)``: patterns that use up ``counts`` items of each length 1..capacity."""
    left = np.zeros(capacity + 1, "i8")
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in pattern:
            need[x] += 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            out.append((pattern, n))

    if left[capacity]:
        take((capacity,))
    for a in range(capacity - 1, capacity // 2 - 1, -1):  # pairs: the complement of a single length
        if left[a] and left[capacity - a]:
            take((a, capacity - a))
    for a in range(capacity - 2, 0, -1):  # triples: a pair sum that completes a, the longer partner first
        gap = capacity - a
        b = np.arange(min(a, gap - 1), (gap - 1) // 2, -1)
        for x in b[(left[b] > 0) & (left[gap - b] > 0)].tolist():
            if not left[a]:
                break
            take((a, x, gap - x))
    for a in range(capacity - 3, 0, -1):  # fours: two pair sums that complete each other
        if not left[a]:
            continue
        for b in range(min(a, capacity - a - 2), 0, -1):
            gap = capacity - a - b
            if gap > 2 * b or not left[a]:
                continue
            if left[b] <= (a == b):
                continue
            c = np.arange(min(b, gap - 1), (gap - 1) // 2, -1)
            for x in c[(left[c] > 0) & (left[gap - c] > 0)].tolist():
                take((a, b, x, gap - x))

    gaps: dict[int, list[list]] = {}  # free tokens -> [pattern, how many]
    open_gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(open_gaps, gap)
        gaps[gap].append([pattern, n])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            gap = open_gaps[at]
            entry = gaps[gap][-1]
            each = min(gap // length, n)
            used = min(entry[1], n // each)
            entry[1] -= used
            pattern = entry[0]
            if not entry[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(at)
            put(gap - each * length, pattern + (length,) * each, used)
            n -= used * each
    for entries in gaps.values():
        out.extend((p, n) for p, n in entries if n)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to pieces of an integer length from 1 to ``capacity``. ``pieces`` is read twice, so it
    should be a written table."""
    ranked = numbered_within(pieces, length, list(order), "rank")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, offset
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in plan(counts, capacity):
        offset = 0
        for x in pattern:
            runs[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    # One run per slot of a pattern; the patterns are bounded by the sequence length, not by the rows.
    tables = pieces.sparkSession.sparkContext.broadcast({x: tuple(np.array(c, "i8") for c in zip(*r, strict=True)) for x, r in runs.items()})
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column(length).to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(ranks), "i8"), np.zeros(len(ranks), "i8")
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                first, start, offset = tables.value[int(x)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                seq[at], off[at] = start[k] + ranks[at] - first[k], offset[k]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, control_text: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself, and a null id stays null. An
    empty table gives an empty result. Other columns are not looked at. A control string in a text is what the library's
    ``encode`` makes of it unless ``control_text`` is set.
    """
    held = Stash(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, control_text), "pieces").df
    return pack(held, capacity)
