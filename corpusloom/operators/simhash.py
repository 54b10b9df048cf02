"""SimHash of character n-grams with block search (the corpus-deduplication form; 64 bits)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.graph import connected_components, spanning_links
from corpusloom.plans.storage import Stash

FEATURE_BITS, DISTANCE, BLOCKS, GRAM, LEAST, DENSE = 64, 3, 4, 3, 5, 256


def majority_of(h: np.ndarray, bits: int = FEATURE_BITS) -> int:
    """A bit is set if more of the unsigned 64-bit hashes have it than not."""
    votes = ((h[:, None] >> np.arange(bits, dtype="u8")) & np.uint64(1)).sum(axis=0, dtype="i8")
    return int(((2 * votes > len(h)).astype("u8") << np.arange(bits, dtype="u8")).sum(dtype="u8"))


def native_simhash(text: Column, n: int = GRAM, least: int = LEAST) -> Column:
    """Of the distinct lower-cased character n-grams under XXH3-64, as a signed long; 0 for shorter texts."""

    @F.pandas_udf("long")
    def sign(s: pd.Series) -> pd.Series:
        def one(t):
            t = (t or "").lower()
            if len(t) < least:
                return 0
            h = np.array([xxhash.xxh3_64_intdigest(g) for g in {t[i : i + n] for i in range(max(1, len(t) - n + 1))}], "u8")
            value = majority_of(h)
            return value - (1 << 64) if value >> 63 else value

        return s.map(one)

    return sign(text)


def portable_simhash(text: Column, n: int = GRAM, bits: int = 28) -> Column:
    """Bit votes over the distinct lower-cased character n-grams' MD5 values (their first ``bits`` / 4 hex digits), which
    any SQL engine can compute; null for a text without n-grams."""

    def one(t: str | None) -> int | None:
        t = (t or "").lower()
        grams = {t[i : i + n] for i in range(len(t) - n + 1)}
        if not grams:
            return None
        h = np.frombuffer(b"".join([hashlib.md5(g.encode()).digest()[:8] for g in grams]), ">u8").astype("u8") >> np.uint64(64 - bits)
        return majority_of(h, bits)

    @F.pandas_udf("long")
    def sign(s: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in s], dtype="Int64")

    return sign(text)


def block_keys(sig: Column, bits: int = FEATURE_BITS, distance: int = DISTANCE, blocks: int = BLOCKS) -> Column:
    """Array of (choice, key): every choice of blocks - distance blocks, and the signature's bits in them."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    out = []
    for c, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(c).alias("choice"), sig.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def _near_sets(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) as places in left followed by right: the pairs within ``distance``, each place linked to one."""
    src, dst = [], []
    for i in range(0, len(left), 128):
        a, b = np.nonzero(np.bitwise_count(left[i : i + 128, None] ^ right[None, :]) <= distance)
        src.append(a + i)
        dst.append(b + len(left))
    return spanning_links(np.concatenate(src), np.concatenate(dst), len(left) + len(right))


def near_edges(signed: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bits: int = FEATURE_BITS, id_col: str = "id", sig: str = "simhash", dense: int = DENSE, block: int = 2048) -> DataFrame:
    """(src, dst): edges whose connected sets are those of all pairs of rows within ``distance`` bits. A null signature
    links to nothing.

    Copies link to the first row of their signature. A key that more than ``dense`` signatures share is compared in
    blocks of about ``block`` in numpy, which gives a link per signature and not one per pair.
    """
    rows = Stash(signed.select(F.col(id_col).alias("id"), F.col(sig).alias("sig")), "simhashes").df
    first = Stash(rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id")), "distinct").df
    keyed = Stash(first.select("id", "sig", F.inline(block_keys(F.col("sig"), bits, distance, blocks))), "keyed").df
    sizes = Stash(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes").df
    few = keyed.join(sizes.where(F.col("n") <= dense), ["choice", "key"])
    left, right = (few.select("choice", "key", F.col("id").alias(i), F.col("sig").alias(s)) for i, s in (("src", "a"), ("dst", "b")))
    near = left.join(right, ["choice", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("src", "dst").distinct()
    many = keyed.join(sizes.where(F.col("n") > dense), ["choice", "key"]).withColumn("block", F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / block)))
    packed = Stash(many.groupBy("choice", "key", "block").agg(F.collect_list(F.struct("sig", "id")).alias("m")), "crowded").df
    pairs = packed.toDF("choice", "key", "i", "x").join(packed.toDF("choice", "key", "j", "y"), ["choice", "key"]).where("i <= j").select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                (a, ia), (b, ib) = ((v.field("sig").to_numpy().view("u8"), v.field("id").to_numpy()) for v in (x.values, y.values))
                src, dst = _near_sets(a, b, distance)
                ids = np.r_[ia, ib]
                keep = ids[src] != ids[dst]
                yield pa.RecordBatch.from_arrays([pa.array(ids[src][keep]), pa.array(ids[dst][keep])], names=["src", "dst"])

    crowded = pairs.mapInArrow(compare, "src long, dst long")
    copies = rows.join(first.withColumnRenamed("id", "dst"), "sig").where("id != dst").select(F.col("id").alias("src"), "dst")
    return near.union(crowded).union(copies)


def simhash_clusters(signed: DataFrame, **kw) -> DataFrame:
    """id, component for every row; ids are longs, and those without a near copy are components of their own."""
    signed = Stash(signed, "signed").df
    ids = signed.select(F.col(kw.get("id_col", "id")).alias("id"))
    c = connected_components(near_edges(signed, **kw)).toDF("id", "component")
    return ids.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
