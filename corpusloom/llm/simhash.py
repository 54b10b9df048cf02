"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most ``distance`` bits. The bits are dealt into m partitions so that
correlated bits share one (correlations are counted over all distinct fingerprints). If thresholds t_1..t_m >= -1 add
up to distance - m + 1, two linked fingerprints agree up to t_i bits in at least one partition i with t_i >= 0. For
each probing fingerprint the thresholds are chosen by dynamic programming on the candidate counts that the value
histograms of the partitions foretell, so a partition value that half the corpus shares is skipped by most probes.

Only distinct fingerprints take part, so copies cost nothing. Probes meet indexed values by an equi-join; a value with
more than ``dense`` fingerprints is compared instead in blocks of ``dense`` inside numpy, which gives a star of links
per block and no row for each pair. Either way the links connect the same sets, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import values
from corpusloom.llm.keys import keep_listed, text_of
from corpusloom.operators.graph import connected_components
from corpusloom.plans.storage import Stash

DISTANCE, PARTS, DENSE, SHINGLE = 3, 4, 256, 3


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles (repeats count): a bit is 1 if it is set in over half of their XXH64 values.

    A-Z are lower-cased, words are split at ASCII white space. Fewer words than a shingle: the whole sequence is the
    one shingle. No words, or a null text: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    flat = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [digest(flat, 42)]
    else:
        starts = np.r_[0, ends[: n - 1]].tolist()
        hashes = [digest(flat[s:e], 42) for s, e in zip(starts, (ends[words_per_shingle - 1 :] - 1).tolist(), strict=True)]
    octets = np.array(hashes, dtype=">u8").view("u1").reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        votes += np.unpackbits(octets[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype="u8").view("i8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha: bool = False) -> DataFrame:
    """``(id, fp)``: the fingerprint of each row as a signed long; with ``sha`` also the SHA-256 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed([fingerprint(t) for t in values(b.column(1))])), *b.columns[2:]], names=names)

    names = ["id", "fp", "sha"] if sha else ["id", "fp"]
    extra = [F.unhex(F.sha2(text_of(text_col), 256)).alias("sha")] if sha else []
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *extra).mapInArrow(run, "id long, fp long" + ", sha binary" * sha)


# -- the plan: partitions of bits and candidate counts ---------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones, bit 0 first."""
    return ((fps.view("u8")[:, None] >> np.arange(64, dtype="u8")) & np.uint64(1)).astype("f4")


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as a small integer."""
    u, out = fps.view("u8"), np.zeros(len(fps), "u8")
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.astype("i8")


def correlated_partitions(together: np.ndarray, ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal 64 bits into ``parts`` equal groups, each grown around a seed by the largest absolute correlation."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        seed = max(sorted(free), key=lambda b: sum(r[b, x] for x in free if x != b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: r[b, group].mean())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def ball_counts(histogram: np.ndarray, width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most: for every value, how many fingerprints have a value within t bits of it."""
    index, h = np.arange(1 << width), histogram.astype("f8")
    shell = [h] + [np.zeros_like(h) for _ in range(most)]
    for b in range(width):
        flip = index ^ (1 << b)
        for t in range(most, 0, -1):
            shell[t] = shell[t] + shell[t - 1][flip]
    # Taking bit positions in order counts each value at distance t once: shell[t][v] sums h over t flipped bits.
    return list(np.cumsum(shell, axis=0))


def allocate(costs: np.ndarray, units: int) -> np.ndarray:
    """Thresholds by dynamic programming.

    costs[i, u] holds, for each fingerprint, what u units cost in partition i (u = threshold + 1; 0 units skip it).
    The units of all partitions add up to ``units``; returns the thresholds, partitions x fingerprints.
    """
    parts, _, n = costs.shape
    best, choice = np.full((units + 1, n), np.inf), np.zeros((parts, units + 1, n), "i1")
    best[0] = 0
    for i in range(parts):
        following = np.full((units + 1, n), np.inf)
        for total in range(units + 1):
            options = np.stack([best[total - u] + costs[i, u] for u in range(total + 1)])
            choice[i, total] = options.argmin(axis=0)
            following[total] = options.min(axis=0)
        best = following
    left, out = np.full(n, units), np.zeros((parts, n), "i1")
    for i in range(parts - 1, -1, -1):
        out[i] = choice[i, left, np.arange(n)]
        left = left - out[i]
    return out - 1


def _flips(width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most: all masks of ``width`` bits with exactly t bits set."""
    masks, out = [0], []
    for t in range(most + 1):
        out.append(np.array(masks, "i8"))
        masks = sorted({m | 1 << b for m in masks for b in range(width) if not m >> b & 1}) if t < most else []
    return out


def _sums(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, over all distinct fingerprints (64 x 64 numbers), and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b.column("fp").to_numpy())
            total, n = total + (x.T @ x), n + len(x)
        if n:
            cell = np.append(total.ravel(), n).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype="i4")), pa.array(cell)], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(4097)
    flat[rows["cell"]] = rows["n"]
    return flat[:4096].reshape(64, 64), int(flat[4096])


def _histograms(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Per partition, how many distinct fingerprints have each value: at most parts x 2^(64 / parts) numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << len(g), "i8") for g in groups]
        for b in batches:
            for h, g in zip(seen, groups, strict=True):
                h += np.bincount(_gather(b.column("fp").to_numpy(), g), minlength=len(h))
        for i, h in enumerate(seen):
            v = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, "i4")), pa.array(v.astype("i8")), pa.array(h[v])], names=["part", "value", "n"])

    rows = distinct.select("fp").mapInArrow(count, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(1 << len(g), "i8") for g in groups]
    for i, r in rows.groupby("part"):
        out[i][r["value"]] = r["n"]
    return out


_PROBE = "part int, value long, fp long, probe boolean, dense boolean, block int"


def _signatures(distinct: DataFrame, groups: list[list[int]], histograms: list[np.ndarray], distance: int, dense: int, block: int) -> DataFrame:
    """A row for each fingerprint and partition (indexed), and one for each value that a fingerprint probes."""
    balls = [ball_counts(h, len(g), distance) for h, g in zip(histograms, groups, strict=True)]
    flips = [_flips(len(g), distance) for g in groups]
    shared = distinct.sparkSession.sparkContext.broadcast((balls, flips))  # parts x (distance + 1) x 2^(64 / parts) numbers

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, flips = shared.value
        for b in batches:
            fps = b.column("fp").to_numpy()
            if not len(fps):
                continue
            values = [_gather(fps, g) for g in groups]
            costs = np.zeros((len(groups), distance + 2, len(fps)))
            for i, v in enumerate(values):
                for t in range(distance + 1):
                    costs[i, t + 1] = balls[i][t][v] + sum(len(m) for m in flips[i][: t + 1])
            thresholds = allocate(costs, distance + 1)
            mixed = (fps.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for i, v in enumerate(values):
                for probe, t in [(False, 0), *((True, t) for t in range(distance + 1))]:
                    who = np.flatnonzero(thresholds[i] >= t) if probe else np.arange(len(fps))
                    if not len(who):
                        continue
                    masks = flips[i][t]
                    value = (v[who][:, None] ^ masks).ravel()
                    fp = np.repeat(fps[who], len(masks))
                    n = balls[i][0][value]
                    hold = n > 0  # a value that nobody has needs no probe
                    value, fp, n, mix = value[hold], fp[hold], n[hold], np.repeat(mixed[who], len(masks))[hold]
                    blocks = np.maximum(1, np.ceil((balls[i][distance][value] if probe else n) / block)).astype("u8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), i, "i4")), pa.array(value), pa.array(fp), pa.array(np.full(len(fp), probe)), pa.array(n > dense), pa.array((mix % blocks).astype("i4"))],
                        names=["part", "value", "fp", "probe", "dense", "block"],
                    )

    return distinct.select("fp").mapInArrow(emit, _PROBE)


def _block_links(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``distance`` connect: each fingerprint to the least of its set."""
    near = np.empty((len(left), len(right)), bool)
    for i in range(0, len(left), 128):
        near[i : i + 128] = np.bitwise_count(left[i : i + 128, None] ^ right[None, :]) <= distance
    a, b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near, left, right = near[np.ix_(a, b)], left[a].view("i8"), right[b].view("i8")
    if not len(left):
        return left, left
    top = np.iinfo("i8").max
    la, lb = left.copy(), right.copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return np.r_[left, right], np.r_[la, lb]


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, dense: int = DENSE, block: int = 2048) -> DataFrame:
    """``(src, dst)``: edges between the distinct fingerprints of column fp, with the same connected sets as all pairs
    within ``distance`` bits."""
    together, n = _sums(distinct)
    groups = correlated_partitions(together, np.diag(together), n, parts)
    rows = Stash(_signatures(distinct, groups, _histograms(distinct, groups), distance, dense, block), "signatures").df
    key = ["part", "value"]
    probes = rows.where("probe and not dense").select(*key, F.col("fp").alias("src"))
    indexed = rows.where("not probe and not dense").select(*key, F.col("fp").alias("dst"))
    sparse = probes.join(indexed, key).where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance))
    # Block numbers come from the histograms, so a block has about ``block`` fingerprints however large its value is.
    packed = rows.where("dense").groupBy(*key, "probe", "block").agg(F.collect_list("fp").alias("fps"))
    crowded = packed.where("probe").select(*key, F.col("fps").alias("a")).join(packed.where("not probe").select(*key, F.col("fps").alias("b")), key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                src, dst = _block_links(a.values.to_numpy().view("u8"), b.values.to_numpy().view("u8"), distance)
                keep = src != dst
                yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep])], names=["src", "dst"])

    return sparse.select("src", "dst").union(crowded.select("a", "b").mapInArrow(compare, "src long, dst long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int = DISTANCE, parts: int = PARTS, dense: int = DENSE, sha: bool = False) -> DataFrame:
    """The rows of ``fingerprints`` with root, which names the group by a fingerprint, and component_id."""
    held = Stash(fingerprints(docs, id_col, text_col, sha), "fingerprints").df
    distinct = Stash(held.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = Stash(connected_components(links(distinct.df, distance, parts, dense)), "linked")
    roots = distinct.df.join(linked.df.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = Stash(roots, "named")
    least = named.df.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = Stash(named.df.join(least, "root").select("fp", "root", "component_id"), "by_fp").df
    for x in (distinct, linked, named):
        x.drop()
    return held.join(by_fp, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, parts: int = PARTS, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``distance`` differing bits. Null and empty texts
    have fingerprint zero and link like others. Repeated rows each keep their row; a null id gets a component like any
    other row but is never its name (unless all ids of it are null). An empty table gives an empty result. Other
    columns are not looked at.
    """
    return _grouped(docs, id_col, text_col, distance, parts, dense).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id (a null id being the largest) and,
    of several with that id, of the smallest SHA-256 of the text; all columns stay.

    Null and empty texts are near copies of each other. Of rows that repeat id and text one stays (any of them, should
    other columns differ). An empty table stays empty; columns of any name may be there.
    """
    rows = _grouped(docs, id_col, text_col, sha=True)
    keys = rows.groupBy("root", "id", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha", "n")).alias("row"))
    return keep_listed(docs, Stash(first.select("row.id", "row.sha", "row.n"), "kept").df, id_col, text_col)
