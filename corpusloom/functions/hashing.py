"""Hash functions: built-in ones as columns, others in Python with numpy where many seeds are wanted."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, functions as F, types as T

MASK32, MASK64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32(grams: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """MurmurHash3 x86_32 of every gram under every seed (grams x seeds); grams of one length are hashed together."""
    out = np.zeros((len(grams), len(seeds)), "u4")
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, g in enumerate(grams):
        by_length[len(g)].append(i)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    with np.errstate(over="ignore"):
        for n, at in by_length.items():
            data = np.frombuffer(b"".join(grams[i].ljust(-(-n // 4) * 4, b"\0") for i in at), "<u4").reshape(len(at), -1)
            h = np.broadcast_to(seeds.astype("u4"), (len(at), len(seeds))).copy()
            for b in range(data.shape[1]):
                k = _rotl(data[:, b] * c1, 15) * c2
                h ^= k[:, None]
                if b < n // 4:  # a tail is mixed in without the last steps
                    h = _rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(n)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[at] = h ^ (h >> np.uint32(16))
    return out


def murmur3_minima(grams: Iterable[bytes], seeds: np.ndarray, signed: bool = False, block: int = 256) -> np.ndarray:
    """The least MurmurHash3 x86_32 of the grams under every seed, of some ``block`` grams at a time and in place, so that
    the numbers stay in a core's cache."""
    kind = "i4" if signed else "u4"
    least, u4 = np.full(len(seeds), np.iinfo(kind).max, kind), np.uint32
    room = np.empty((2, len(seeds), block), "u4")
    by_length: dict[int, list[bytes]] = defaultdict(list)
    for g in grams:
        by_length[len(g)].append(g)
    with np.errstate(over="ignore"):
        for n, same in by_length.items():
            pad = b"\0" * (-n % 4)
            k = np.frombuffer(b"".join([g + pad for g in same]) if pad else b"".join(same), "<u4").reshape(len(same), -1)
            k = _rotl(k * u4(0xCC9E2D51), 15) * u4(0x1B873593)
            for i in range(0, len(k), block):
                words = k[i : i + block]
                h, t = room[:, :, : len(words)]
                h[:] = seeds[:, None]
                for b in range(k.shape[1]):
                    h ^= words[:, b]
                    if b < n // 4:  # a tail is mixed in without the last steps
                        np.right_shift(h, u4(19), out=t)
                        np.left_shift(h, u4(13), out=h)
                        h |= t
                        h *= u4(5)
                        h += u4(0xE6546B64)
                h ^= u4(n)
                for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                    np.right_shift(h, u4(shift), out=t)
                    h ^= t
                    h *= u4(factor)
                np.right_shift(h, u4(16), out=t)
                h ^= t
                np.minimum(least, h.view(kind).min(axis=1), out=least)
    return least


def _rot64(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & MASK64


def _fmix64(k: int) -> int:
    k = ((k ^ (k >> 33)) * 0xFF51AFD7ED558CCD) & MASK64
    k = ((k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53) & MASK64
    return k ^ (k >> 33)


def murmur3_x64_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64_128 as two unsigned numbers."""
    c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed & MASK32, seed & MASK32
    mix1 = lambda k: (_rot64((k * c1) & MASK64, 31) * c2) & MASK64
    mix2 = lambda k: (_rot64((k * c2) & MASK64, 33) * c1) & MASK64
    body = len(data) // 16 * 16
    for i in range(0, body, 16):
        h1 ^= mix1(int.from_bytes(data[i : i + 8], "little"))
        h1 = ((_rot64(h1, 27) + h2) * 5 + 0x52DCE729) & MASK64
        h2 ^= mix2(int.from_bytes(data[i + 8 : i + 16], "little"))
        h2 = ((_rot64(h2, 31) + h1) * 5 + 0x38495AB5) & MASK64
    tail = data[body:]
    if len(tail) > 8:
        h2 ^= mix2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= mix1(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK64
    h2 = (h2 + h1) & MASK64
    h1, h2 = _fmix64(h1), _fmix64(h2)
    h1 = (h1 + h2) & MASK64
    return h1, (h2 + h1) & MASK64


def fnv1a_32(data: bytes, seed: int = 0) -> int:
    """A seed other than 0 takes the place of the basis."""
    h = seed & MASK32 or 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & MASK32
    return h


def fnv1a_64(data: bytes, seed: int = 0) -> int:
    """A seed is mixed into the basis by exclusive or."""
    h = 0xCBF29CE484222325 ^ (seed & MASK64)
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & MASK64
    return h


def fnv1a_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Two 64-bit values under two seeds."""
    return fnv1a_64(data, seed), fnv1a_64(data, seed ^ 0x9E3779B9)


def sha1_bits(data: bytes, bits: int = 32) -> int:
    return int.from_bytes(hashlib.sha1(data).digest()[: bits // 8], "little")


def xxh3_bits(data: bytes, bits: int = 64, seed: int = 0) -> int:
    return xxhash.xxh3_128_intdigest(data, seed) if bits == 128 else xxhash.xxh3_64_intdigest(data, seed) & ((1 << bits) - 1)


def fnv1a_32_all(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """FNV-1a of many texts at once, a byte of every text at a step; longest texts first, so finished ones fall away."""
    out = np.full(len(texts), seed & MASK32 or 0x811C9DC5, "u4")
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order], "i8")
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    flat = np.frombuffer(b"".join(texts[i] for i in order), "u1")
    h = out[order]
    for at in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # texts longer than ``at``
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * np.uint32(0x01000193)
    out[order] = h
    return out


@F.pandas_udf(T.LongType())
def fnv1a_32_column(s: pd.Series) -> pd.Series:
    """FNV-1a of texts, a batch at a time."""
    known = s.notna()
    out = pd.Series(pd.NA, index=s.index, dtype="Int64")
    out[known] = fnv1a_32_all([t.encode("utf-8") for t in s[known]]).astype("i8")
    return out


def hash_udf(f, **kw):
    """An Arrow UDF of a Python hash of UTF-8 text; values of 64 bits come out as signed longs."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        values = [None if x is None else f(x.encode("utf-8"), **kw) for x in s]
        return pd.Series([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], dtype="Int64")

    return run


def sha1_32(c: Column) -> Column:
    """The first four bytes of SHA-1, little-endian, with built-in functions."""
    h = F.sha1(c)
    turned = F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in (3, 2, 1, 0)])
    return F.conv(turned, 16, 10).cast("long")


#: Bands and rows of the usual signature sizes.
PRESETS = ((20, 450), (20, 40), (20, 10))


def hash_column(name: str, **kw):
    """The hash of a name, as a function of a column: md5, sha1, sha256 (hexadecimal), sha1_32, xxh64 (built in), or
    murmur3_32, murmur3_x64_128, fnv1a_32, fnv1a_64, xxh3 in Python, as longs (of 128 bits the first half)."""
    built_in = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha1_32": sha1_32, "xxh64": F.xxhash64}
    if name in built_in:
        return built_in[name]
    seed = kw.get("seed", 0)
    python = {
        "murmur3_32": lambda data: int(murmur3_32([data], np.array([seed], "u4"))[0, 0]),
        "murmur3_x64_128": lambda data: murmur3_x64_128(data, seed)[0],
        "fnv1a_32": lambda data: fnv1a_32(data, seed),
        "fnv1a_64": lambda data: fnv1a_64(data, seed),
        "xxh3": lambda data: xxh3_bits(data, kw.get("bits", 64), seed),
    }
    return hash_udf(python[name])


@lru_cache(64)
def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5, steps: int = 400) -> tuple[int, int]:
    """Bands and rows that minimise the weighted areas of false positives and false negatives."""

    def area(lo: float, hi: float, curve) -> float:
        s = lo + (hi - lo) * (np.arange(steps) + 0.5) / steps
        return float(curve(s).mean() * (hi - lo))

    best, found = np.inf, (1, 1)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            error = fp_weight * area(0, threshold, lambda s: 1 - (1 - s**r) ** b) + fn_weight * area(threshold, 1, lambda s: (1 - s**r) ** b)
            if error < best - 1e-15:
                best, found = error, (b, r)
    return found


def match_probability(s: Column, bands: int, rows: int) -> Column:
    return 1 - F.pow(1 - F.pow(s, F.lit(rows)), F.lit(bands))


def band_threshold(bands: int, rows: int) -> float:
    return (1 / bands) ** (1 / rows)
