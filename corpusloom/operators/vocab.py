"""Vocabulary tables and the greedy longest-match tokenizer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.ngrams import whitespace_words


def word_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token: the distinct white-space words."""
    return docs.select(F.explode(whitespace_words(F.col(text_col))).alias("token")).distinct()


def mask_digit_tokens(vocab: DataFrame) -> DataFrame:
    """id, target: tokens with digits map to the least id of their form with every digit as 0."""
    masked = vocab.select("token", "id", F.regexp_replace("token", "[0-9]", "0").alias("masked"))
    least = masked.groupBy("masked").agg(F.min("id").alias("target"))  # combined before the shuffle, however common a form is
    return masked.join(least, "masked").select("id", "target")


def merge_vocab(base: DataFrame, extra: DataFrame, first: int = 1024, last: int = 65529) -> DataFrame:
    """token, id: ``base`` and those tokens of ``extra`` that it lacks, with the smallest free ids in token order.
    Tokens beyond the last free id have a null id."""
    new = extra.select("token").distinct().join(base, "token", "left_anti")
    free = base.sparkSession.range(first, last + 1).join(base.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
    # At most last - first + 1 tokens get an id, so both numberings are over small tables however long ``extra`` is.
    numbered = new.orderBy("token").limit(last - first + 1).withColumn("n", F.row_number().over(Window.orderBy("token")))
    slots = free.withColumn("n", F.row_number().over(Window.orderBy("id")))
    given = numbered.join(slots, "n").select("token", "id")
    return base.select("token", F.col("id").cast("long").alias("id")).union(new.join(given, "token", "left").select("token", "id"))


class LongestMatch:
    """Greedy tokenizer over UTF-8 bytes; a byte that begins no token becomes its value plus one.

    Where no token holds a blank next to something else, no token reaches over a blank: a text is cut at its blanks, and
    short pieces are encoded once and remembered, up to ``most`` of them.
    """

    def __init__(self, vocab: Iterable[tuple[str, int]], most: int = 200_000):
        self.ids = {t.encode("utf-8"): i for t, i in vocab if not 128 <= i <= 256 and i}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.pieces = {i: bytes([i - 1]) for i in range(1, 257)} | self.tokens
        self.apart = all(t == b" " or b" " not in t for t in self.ids)
        self.most, self.known, self.tree = most, {}, None

    def _grown(self) -> list:
        """For each first byte (best, {next byte: (best, ...)}): best is the code and length of the longest token on the way
        there. It is grown where it is first used, since it is far larger than the vocabulary."""
        leaf: dict = {}
        tree = [[((b + 1).to_bytes(4, "little"), 1), leaf] for b in range(256)]
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):  # shorter ones first, so a node's best is known when a longer token passes
            if not t:
                continue
            node = tree[t[0]]
            for b in t[1:]:
                if node[1] is leaf:
                    node[1] = {}
                node = node[1].setdefault(b, [node[0], leaf])
            node[0] = (i.to_bytes(4, "little", signed=True), len(t))
        return tree

    def _scan(self, data: bytes) -> bytes:
        if self.tree is None:
            self.tree = self._grown()
        tree, at, end, out = self.tree, 0, len(data), []
        while at < end:
            best, more = tree[data[at]]
            i = at + 1
            while i < end and (node := more.get(data[i])) is not None:
                best, more = node
                i += 1
            out.append(best[0])
            at += best[1]
        return b"".join(out)

    def _piece(self, data: bytes) -> bytes:
        out = self.known.get(data)
        if out is None:
            out = self._scan(data)
            if len(data) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[data] = out
        return out

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers, little-endian."""
        data = text.encode("utf-8")
        return self._piece(b" ").join([self._piece(p) for p in data.split(b" ")]) if self.apart else self._scan(data)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def encode_udf(vocab: Iterable[tuple[str, int]]):
    tokenizer = LongestMatch(vocab)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else tokenizer.packed(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(r) // 4 if r else 0 for r in rows)]).astype("i4")
        values = pa.array(np.frombuffer(b"".join(filter(None, rows)), "<i4"))
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([r is None for r in rows], pa.bool_()))

    return encode


def decode_udf(vocab: Iterable[tuple[str, int]]):
    tokenizer = LongestMatch(vocab)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if r is None else tokenizer.decode(r.tolist()) for r in numbers(ids)], pa.string())

    return decode


def numbers(lists: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The lists of an Arrow array as numpy arrays, null ones as None."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for a, b, known in zip(ends[:-1], ends[1:], lists.is_valid().to_numpy(zero_copy_only=False), strict=True):
        yield values[a:b] if known else None


def lost_characters(a: Column, b: Column) -> Column:
    """Characters of a that b lacks."""
    return F.array_except(F.split(a, ""), F.split(b, ""))
