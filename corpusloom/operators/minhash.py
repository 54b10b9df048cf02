"""MinHash signatures, LSH bands and the duplicate rules built on them.

``portable`` signatures use MD5 and affine maps modulo 2^31 - 1, so that any SQL engine can compute them. The native
ones are bit-compatible with MurmurHash3 pipelines. Signatures are computed in Arrow batches by numpy; what is shuffled
is band keys, never texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.hashing import MASK32, murmur3_minima
from corpusloom.functions.normalize import feature_text
from corpusloom.functions.similarity import estimated_jaccard
from corpusloom.operators.graph import connected_components, spanning_links
from corpusloom.plans.ordering import numbered
from corpusloom.plans.storage import Stash, once, spread

PRIME = (1 << 31) - 1
BUCKETS, BUCKET_SIZE, GRAM = 20, 10, 5
_APART = re.compile("[^a-z0-9]+").split


def permutations(k: int) -> list[tuple[int, int]]:
    """k pairs (a, b) for h -> (a h + b) mod PRIME, from MD5 of their numbers."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    return [(number(f"a{i}") + 1, number(f"b{i}")) for i in range(k)]


def portable_signature(text: Column, k: int = 32, n: int = 5) -> Column:
    """Signature over n-word shingles of ASCII words; null for fewer than n words."""
    factors, summands = np.array(permutations(k), "u8").T[:, :, None]

    def one(t: str | None) -> np.ndarray | None:
        words = [w for w in _APART(t.lower()) if w] if t else []
        if len(words) < n:
            return None
        digest = hashlib.md5
        grams = set(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
        h = np.frombuffer(b"".join([digest(g.encode()).digest()[:4] for g in grams]), ">u4").astype("u8") >> np.uint64(4)  # seven hex digits
        return affine_31(h, factors, summands)

    @F.pandas_udf("array<long>")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(one)

    return sign(text)


def affine_31(h: np.ndarray, factors: np.ndarray, summands: np.ndarray, block: int = 512) -> np.ndarray:
    """The least (h a + b) mod PRIME of each pair of columns a, b, for h below 2^28 and a, b of at most 2^28, so that one
    fold at bit 31 (2^31 is 1 for this modulus) and one subtraction reduce it; ``block`` values at a time stay in the cache."""
    prime, top = np.uint64(PRIME), np.uint64(31)
    least = np.full(len(factors), PRIME, "u8")
    for i in range(0, len(h), block):
        x = factors * h[i : i + block]
        x += summands
        y = x >> top
        x &= prime
        x += y
        np.subtract(x, prime, out=y)  # wraps round to a large number where x is the lesser
        np.minimum(x, y, out=x)
        np.minimum(least, x.min(axis=1), out=least)
    return least.astype("i8")


def bands(signature: Column, b: int, r: int) -> Column:
    """Array of (band, key) of a signature of at least b x r values."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice(signature, i * r + 1, F.lit(r)).cast("array<string>"), "_")).alias("key")))


def share_band(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def exploded(docs: DataFrame, signature: Column, b: int, r: int, id_col: str = "doc_id") -> DataFrame:
    """id, band, key. A document without a signature has no keys; ``flags`` and ``cluster`` give it a row from ``ids``."""
    return once(spread(docs), "s", signature, F.col(id_col).alias("id")).where("s is not null").select("id", F.inline(bands(F.col("s"), b, r)))


def _every(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias("id")).distinct()


def flags(keys: DataFrame, pooled: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """id, duplicate for rows (id, band, key): whether a key was seen at a smaller id (with ``pooled``, in any band).

    Gives what a single pass with a growing set gives. A document is new exactly if it is the first at every one of its
    keys, so minima and counts suffice and the rows of a hot key never meet. ``ids`` lists all documents in its first
    column; those without keys are no duplicates.
    """
    at = ["key"] if pooled else ["band", "key"]
    keys = Stash(keys, "keys").df  # read twice, and signatures are dear
    own = keys.groupBy("id").agg(F.count_distinct(*[F.col(c) for c in at]).alias("d"), F.count(F.lit(1)).alias("n"))
    first = keys.groupBy(*at).agg(F.min("id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("f"))
    again = (F.col("d") < F.col("n")) if pooled else F.lit(False)
    signed = own.join(first, "id", "left").select("id", ((F.coalesce("f", F.lit(0)) < F.col("d")) | again).alias("duplicate"))
    return signed if ids is None else _every(ids).join(signed, "id", "left").select("id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def matched_keys(keys: DataFrame) -> DataFrame:
    """(band, key) that more than one document has: the list that later runs can reject by."""
    return keys.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("band", "key")


def flags_with_list(keys: DataFrame, known: DataFrame) -> DataFrame:
    """As ``flags``, with keys known from before."""
    keys = Stash(keys, "keys").df
    hit = keys.join(known.select("band", "key").distinct(), ["band", "key"], "left_semi").select("id").distinct().withColumn("known", F.lit(True))
    return flags(keys).join(hit, "id", "left").select("id", (F.col("duplicate") | F.coalesce("known", F.lit(False))).alias("duplicate"))


def star_edges(keys: DataFrame) -> DataFrame:
    """(src, dst): each document to the first of each of its keys. By a join with minima that AQE can split."""
    held = Stash(keys, "keys").df
    least = Stash(held.groupBy("band", "key").agg(F.min("id").alias("dst"), F.max("id").alias("top")).where("dst != top").drop("top"), "least").df
    return held.join(least, ["band", "key"]).where("id != dst").select(F.col("id").alias("src"), "dst").distinct()


def cluster(keys: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, component for every document of ``keys``: documents that share keys, directly or over others. ``ids`` lists
    all documents in its first column; those without keys are components of their own."""
    keys = Stash(keys, "keys").df if ids is None else keys
    c = connected_components(star_edges(keys))
    every = _every(keys.select("id") if ids is None else ids)
    return every.join(c.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def band_hashes(signature: Column, b: int, r: int) -> Column:
    """A 64-bit key for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(F.slice(signature, i * r + 1, F.lit(r)).cast("array<string>")))


def shingle_set(text: Column, n: int = GRAM) -> Column:
    """Sorted distinct XXH3-64 values of the n-word shingles that ``portable_signature`` hashes; empty for fewer words."""

    @F.pandas_udf("array<long>")
    def cut(s: pd.Series) -> pd.Series:
        def one(t):
            words = [w for w in _APART(t.lower()) if w] if t else []
            grams = map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))
            return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], "u8")).view("i8")

        return s.map(one)

    return cut(text)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of sorted arrays of distinct values, of which not both are empty."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
        return pd.Series([c / (len(p) + len(q) - c) for c, p, q in zip(both, x, y, strict=True)], dtype="f8")

    return share(a, b)


#: Columns of the incidence matrices that are multiplied at once.
COLUMNS = 4096


def _similarities(x: list[np.ndarray], y: list[np.ndarray], exact: bool) -> np.ndarray:
    """All similarities of two blocks: of sets of hashes by the product of their incidence matrices, of signatures by
    equal positions."""
    if not exact:
        return np.stack([(np.stack(y) == v).mean(axis=1) for v in x])
    sizes = np.array([len(v) for v in [*x, *y]])
    every, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, row = at[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    both = np.zeros((len(x), len(y)), "f4")
    ends = np.searchsorted(at, np.arange(0, len(every) + COLUMNS, COLUMNS))
    for first, a, b in zip(range(0, len(every), COLUMNS), ends[:-1], ends[1:], strict=False):
        held = np.zeros((len(sizes), COLUMNS), "f4")
        held[row[a:b], at[a:b] - first] = 1
        both += held[: len(x)] @ held[len(x) :].T
    return both / (sizes[: len(x), None] + sizes[None, len(x) :] - both)


def _crowded_links(many: DataFrame, values: DataFrame, threshold: float, exact: bool, block: int) -> DataFrame:
    """(src, dst, candidates, verified) from buckets of many sets (id, keys, band, key, n), compared in blocks of about
    ``block``: links that connect what the verified pairs connect, and a row with null ends that counts the pairs. A pair
    belongs to the first band that it shares, so it counts once."""
    dealt = many.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))).join(values, "id")
    packed = Stash(dealt.groupBy("band", "key", "block").agg(F.collect_list(F.struct("id", "keys", "value")).alias("m")), "crowded").df
    sides = (packed.toDF("band", "key", i, m) for i, m in (("i", "x"), ("j", "y")))
    pairs = next(sides).join(next(sides), ["band", "key"]).where("i <= j").select("band", (F.col("i") == F.col("j")).alias("same"), "x", "y")

    def unpacked(v: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = v.values
        return rows.field("id").to_numpy(), np.stack([k.values.to_numpy() for k in rows.field("keys")]), [k.values.to_numpy() for k in rows.field("value")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, same, x, y in zip(*(batch.column(c) for c in ("band", "same", "x", "y")), strict=True):
                (ia, ka, va), (ib, kb, vb) = unpacked(x), unpacked(y)
                mine = np.ones((len(ia), len(ib)), bool)
                for k in range(band.as_py()):
                    mine &= ka[:, None, k] != kb[None, :, k]
                if same.as_py():
                    mine &= ia[:, None] < ib[None, :]
                good = mine & (_similarities(va, vb, exact) >= threshold)
                a, b = np.nonzero(good)
                src, dst = spanning_links(a, b + len(ia), len(ia) + len(ib))
                ids = np.r_[ia, ib]
                keep = ids[src] != ids[dst]
                ends = [np.append(ids[e][keep], 0) for e in (src, dst)]
                last = np.r_[np.zeros(int(keep.sum()), bool), True]
                counts = [np.where(last, int(v.sum()), 0) for v in (mine, good)]
                yield pa.RecordBatch.from_arrays([pa.array(ends[0], mask=last), pa.array(ends[1], mask=last), pa.array(counts[0]), pa.array(counts[1])], names=["src", "dst", "candidates", "verified"])

    return pairs.mapInArrow(compare, "src long, dst long, candidates long, verified long")


def verified_clusters(
    docs: DataFrame, threshold: float = 0.8, k: int = 128, b: int = 16, id_col: str = "doc_id", signature: Column | None = None, verify: str = "exact", dense: int = 64, block: int = 256
) -> tuple[DataFrame, DataFrame]:
    """((id, component), (candidates, verified)): pairs that share a band are verified, and what remains is clustered.

    ``verify``: "exact" by the Jaccard similarity of the word shingles (as 64-bit hashes), "estimate" by that of the
    signatures. Candidates are pairs of distinct shingle sets, or of distinct signatures; equal ones are one class. A
    bucket of more than ``dense`` classes is compared in blocks in numpy, so it makes links and no row for each pair.
    Documents without a signature are components of their own. Ids are distinct longs.
    """
    if verify not in ("exact", "estimate"):
        raise ValueError(f"verify = {verify}")
    signed = spread(docs).select(F.col(id_col).cast("long").alias("id"), (portable_signature(F.col("text"), k) if signature is None else signature).alias("signature"), *([shingle_set(F.col("text")).alias("members")] if verify == "exact" else []))
    by, alike = ("members", set_jaccard) if verify == "exact" else ("signature", estimated_jaccard)
    every = Stash(signed.withColumn("name", F.when(F.col("signature").isNotNull(), F.sha2(F.array_join(F.col(by).cast("array<string>"), "_"), 256))), "signed").df
    rows = every.where("signature is not null")
    classes = Stash(rows.groupBy("name").agg(F.min("id").alias("id")), "classes").df
    firsts = rows.join(classes, ["name", "id"]).dropDuplicates(["id"])
    held = Stash(firsts.select("id", band_hashes(F.col("signature"), b, k // b).alias("keys"), F.col(by).alias("value")), "firsts").df
    values = held.select("id", "value")
    keyed = held.select("id", "keys", F.posexplode("keys").alias("band", "key"))
    sizes = Stash(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes").df
    few = keyed.join(sizes.where(F.col("n") <= dense).drop("n"), ["band", "key"])
    first = F.array_position(F.zip_with("ka", "kb", lambda x, y: x == y), True) - 1
    pairs = few.toDF("band", "key", "a", "ka").join(few.toDF("band", "key", "b", "kb"), ["band", "key"]).where((F.col("a") < F.col("b")) & (first == F.col("band"))).select("a", "b")
    sim = pairs.join(values.toDF("a", "sa"), "a").join(values.toDF("b", "sb"), "b").select("a", "b", alike(F.col("sa"), F.col("sb")).alias("similarity"))
    checked = Stash(sim, "checked").df
    crowded = Stash(_crowded_links(keyed.join(sizes.where(F.col("n") > dense), ["band", "key"]), values, threshold, verify == "exact", block), "links").df
    copies = rows.select("id", "name").join(classes.withColumnRenamed("id", "first"), "name").where("id != first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    good = checked.where(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    c = connected_components(good.union(crowded.where("src is not null").select("src", "dst")).union(copies))
    ids = every.select("id").join(c.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    counts = checked.select(F.lit(1).cast("long").alias("candidates"), (F.col("similarity") >= threshold).cast("long").alias("verified")).union(crowded.select("candidates", "verified"))
    stats = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("candidates", "verified")])
    return ids, stats


def clusters_by_size(members: DataFrame) -> DataFrame:
    """component, size, in order of size, of clusters with more than one member."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1").orderBy(F.desc("size"), "component")


def merged(signatures: DataFrame, group: str, col: str = "signature") -> DataFrame:
    """The signature of a union of sets: elementwise minima."""
    each = signatures.select(group, F.posexplode(col).alias("i", "v")).groupBy(group, "i").agg(F.min("v").alias("v"))
    return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(col))


# -- signatures that other pipelines wrote ----------------------------------------------------------------------------


def _minima(text: str, n: int, k: int, signed: bool = False) -> np.ndarray:
    grams = {text[i : i + n] for i in range(len(text) - n + 1)} or {text}
    return murmur3_minima([g.encode("utf-8") for g in grams], np.arange(k, dtype="u4"), signed)


def bucket_signature(text: Column, buckets: int = BUCKETS, size: int = BUCKET_SIZE, n: int = GRAM) -> Column:
    """``minhashes`` of the main pipeline: per bucket the base64 of the low 16 bits (little-endian) of ``size`` unsigned
    minima of MurmurHash3 under seeds 0, 1, ...; null for texts of fewer than n characters."""

    @F.pandas_udf("array<string>")
    def sign(s: pd.Series) -> pd.Series:
        pack = lambda m: [base64.b64encode(x.tobytes()).decode() for x in (m & np.uint32(0xFFFF)).astype("<u2").reshape(buckets, size)]
        return s.map(lambda t: None if t is None or len(t) < n else pack(_minima(t, n, buckets * size)))

    return sign(text)


def prefixed_signature(text: Column, buckets: int = BUCKETS, size: int = BUCKET_SIZE, n: int = GRAM) -> Column:
    """The older form: ``bucket+`` and the last four hexadecimal digits of each signed minimum's magnitude."""

    def one(t: str) -> list[str]:
        digits = [f"{int(v):04x}"[-4:] for v in _minima(t, n, buckets * size, signed=True)]
        return [f"{i}+" + "".join(digits[i * size : (i + 1) * size]) for i in range(buckets)]

    @F.pandas_udf("array<string>")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else one(t))

    return sign(text)


def char_signature(text: Column, k: int = 128, n: int = 6, seed: int = 1) -> Column:
    """Signature of a web-corpus pipeline: character n-grams of the text in lower case, without ASCII punctuation and with
    white space collapsed, under k affine permutations of 32-bit SHA-1 values modulo 2^61 - 1. A text of fewer than n
    characters is one gram; a null text has no signature."""
    a, b = affine_maps(k, seed)

    @F.pandas_udf("array<long>")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else affine_minima({t[i : i + n] for i in range(max(1, len(t) - n + 1))}, a, b))

    return sign(feature_text(text))


def affine_maps(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of k permutations modulo 2^61 - 1."""
    prime = (1 << 61) - 1
    r = np.random.RandomState(seed)
    a = r.randint(1, prime, k, dtype=np.int64).astype("u8")
    return a, r.randint(0, prime, k, dtype=np.int64).astype("u8")


def affine_minima(grams: set[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least low 32 bits of each permutation of the grams' 32-bit SHA-1 values."""
    h = np.frombuffer(b"".join([hashlib.sha1(g.encode()).digest()[:4] for g in grams]), "<u4").astype("u8")
    out = np.full(len(a), MASK32, "u8")
    for i in range(0, len(h), 1024):
        out = np.minimum(out, (affine_61(h[i : i + 1024, None], a, b) & np.uint64(MASK32)).min(axis=0))
    return out.astype("i8")


def pack_signature(signature: Column) -> Column:
    """The values' low 32 bits, little-endian, in base64: four bytes a value instead of eight."""

    @F.pandas_udf("string")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "i8").astype("<u4").tobytes()).decode())

    return pack(signature)


def unpack_signature(packed: Column) -> Column:
    @F.pandas_udf("array<long>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<u4").astype("i8"))

    return unpack(packed)


def write_signatures(signed: DataFrame, flags: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Parquet of id, signature (packed, null where there is none) and duplicate, for pipelines that go on from there."""
    packed = signed.select(id_col, pack_signature(F.col("signature")).alias("signature"))
    packed.join(flags.select(id_col, "duplicate"), id_col, "left").write.parquet(folder)


def read_signatures(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.select(id_col, unpack_signature(F.col("signature")).alias("signature"), "duplicate")


def word_signature(text: Column, k: int = 256, n: int = 5, least: int = 5, seed: int = 42) -> Column:
    """Affine permutations of 32-bit SHA-1 values of word n-grams, modulo 2^61 - 1; null for under ``least`` tokens.

    Products of 61 and 32 bits are exact in 64-bit words: the factor is split into 29 low and 32 high bits, and 2^61 is 1
    for this modulus. Values are unsigned 32-bit numbers in longs.
    """
    a, b = affine_maps(k, seed)

    def one(t: str | None) -> np.ndarray | None:
        tokens = re.split(r"\W", t) if t is not None else []
        if len(tokens) < least:
            return None
        return affine_minima({" ".join(tokens[i : i + n]).lower() for i in range(max(1, len(tokens) - n + 1))}, a, b)

    @F.pandas_udf("array<long>")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(one)

    return sign(text)


def affine_61(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(h a + b) mod 2^61 - 1 for h below 2^32 and a, b below 2^61, in unsigned 64-bit numbers."""
    p, low, top = np.uint64((1 << 61) - 1), np.uint64(29), np.uint64(61)
    high = h * (a >> low)  # below 2^64; its weight is 2^29
    # high = q 2^32 + r, so high 2^29 = q 2^61 + r 2^29, which is q + r 2^29 here.
    turned = (high >> np.uint64(32)) + ((high & np.uint64(MASK32)) << low)
    total = (turned & p) + (turned >> top) + h * (a & np.uint64((1 << 29) - 1)) + b
    total = (total & p) + (total >> top)
    return np.where(total >= p, total - p, total)


def sort_by_signature(signed: DataFrame, id_col: str = "id", col: str = "signature", out: str = "place") -> DataFrame:
    """id, place (from 1) in the order of signatures and, where they tie, of ids; rows without a signature come last."""
    key = F.when(F.col(col).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(F.transform(col, lambda x: F.lpad(x.cast("string"), 20, "0")), ""))
    return numbered(signed.select(F.col(id_col), F.col(col).isNull().alias("__none"), key.alias("__key")), ["__none", "__key", id_col], out, 1).select(id_col, out)
