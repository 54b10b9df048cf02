"""Intervals, and removal of long repeated passages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from xxhash import xxh3_128_digest

from corpusloom.functions.ngrams import bound, whitespace_words
from corpusloom.plans.storage import spread


def merge_intervals(df: DataFrame, key: str, start: str = "start", stop: str = "stop", strategy: str = "overlapping") -> DataFrame:
    """key, start, stop. ``overlapping`` joins intervals that overlap or touch; ``longest`` drops those inside another."""
    rows = df.select(key, F.col(start).alias("start"), F.col(stop).alias("stop")).distinct()
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"))
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    if strategy == "longest":
        return rows.withColumn("b", before).where("b is null or stop > b").drop("b")
    marked = rows.withColumn("b", before).withColumn("island", F.sum(F.when(F.col("b").isNull() | (F.col("start") > F.col("b")), 1).otherwise(0)).over(order))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def clip_to_documents(segments: DataFrame, bounds: DataFrame, id_col: str = "doc_id", bucket: int = 1 << 16) -> DataFrame:
    """id, start, stop within the document, of global segments and document bounds (start, stop).

    A range join by buckets of offsets: both sides list the buckets that they touch, so it is an equi-join.
    """
    spread = lambda df: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest(F.col("stop") - 1, F.col("start"))) / bucket))))
    s = spread(segments.select(F.col("start"), F.col("stop")).distinct()).toDF("s0", "s1", "__b")
    d = spread(bounds.select(id_col, "start", "stop"))
    joined = d.join(s, "__b").where((F.col("s0") < F.col("stop")) & (F.col("s1") > F.col("start")))
    return joined.select(id_col, (F.greatest("s0", "start") - F.col("start")).alias("a"), (F.least("s1", "stop") - F.col("start")).alias("b")).distinct().toDF(id_col, "start", "stop")


def restore_and_merge(segments: DataFrame, bounds: DataFrame, least: int, strategy: str = "overlapping", id_col: str = "doc_id") -> DataFrame:
    """Clipped segments of at least ``least``, merged."""
    return merge_intervals(clip_to_documents(segments, bounds, id_col).where(F.col("stop") - F.col("start") >= least), id_col, strategy=strategy)


def cut_bytes(text: Column, slices: Column) -> Column:
    """The text without the byte ranges (array of start, stop); the union of the ranges is cut once."""

    @F.pandas_udf("string")
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, ranges in zip(t, s, strict=True):
            data, kept, at = (x or "").encode("utf-8"), [], 0
            for r in sorted((int(r["start"]), int(r["stop"])) for r in (ranges if ranges is not None else [])):
                kept.append(data[at : max(at, r[0])])
                at = max(at, r[1])
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    return cut(text, slices)


#: Passages that a task compares before it sends them, and bytes of input for a bucket of passages.
CHUNK, BUCKET_BYTES = 1 << 20, 16 << 20
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+").findall


def _passages(text: str | None, k: int) -> np.ndarray:
    """The first 96 bits of the XXH3-128 of every run of k words, as rows (h, g)."""
    data = " ".join(_WORDS(text or "")).encode()
    blanks = np.flatnonzero(np.frombuffer(data, "u1") == 32)
    if not data or len(blanks) + 1 < k:
        return np.empty(0, PASSAGE)
    starts, stops = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(data)]
    return np.frombuffer(b"".join([xxh3_128_digest(data[a:b])[:12] for a, b in zip(starts, stops[k - 1 :], strict=False)]), PASSAGE)


PASSAGE = np.dtype([("h", "<u8"), ("g", "<u4")])


def _groups(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows that brings equal (h, g) together, and where in it each group starts."""
    order = np.argsort(h, kind="stable")
    if len(h) and ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    h, g = h[order], g[order]
    return order, np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else order


def _by_document(doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
    return zip(doc[starts].tolist() if len(doc) else [], np.split(at, starts[1:]) if len(doc) else [], strict=True)


def repeated_spans(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, stop (in words): maximal runs of words covered by k-word passages that occur more than once.

    A passage is named by 96 bits of hash and goes to the bucket of its hash once per task and distinct passage, packed with
    its place; of passages that a task meets twice the places are known at once, so a common passage costs a name per task.
    A bucket finds the passages that several tasks sent. Chance collisions among 10^10 passages have odds of 10^-9.
    """
    rows = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, size // BUCKET_BYTES))
    kind = rows.schema["id"].dataType
    sent = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType()), T.StructField("found", T.BooleanType())])

    def packed(ids: list, named: list[np.ndarray], arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for x in named]
        h, g = (np.concatenate([x[c] for x in named]) for c in ("h", "g"))
        doc, at = np.repeat(np.arange(len(ids), dtype="u4"), sizes), np.concatenate([np.arange(1, n + 1, dtype="u4") for n in sizes])
        order, starts = _groups(h, g)
        counts = np.diff(np.r_[starts, len(order)])
        again = order[np.repeat(counts > 1, counts)]
        out = [(i % buckets, [ids[i]], x.tobytes(), True) for i, x in _by_document(doc[again], at[again])]
        one, twice = order[starts], counts > 1
        bucket = (h[one] % np.uint64(buckets)).astype("i8")
        dealt = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
        for b in range(buckets):
            mine = np.sort(dealt[ends[b] : ends[b + 1]])
            if len(mine):
                x = one[mine]
                own, place = np.unique(doc[x], return_inverse=True)
                data = [h[x], g[x], place.astype("u4"), at[x] | (twice[mine].astype("u4") << np.uint32(31))]
                out.append((b, [ids[i] for i in own.tolist()], b"".join(v.tobytes() for v in data), False))
        for i in range(0, len(out), 4096):
            columns = list(zip(*out[i : i + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(arrow), pa.binary(), pa.bool_()), strict=True)], names=sent.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, named, n, arrow = [], [], 0, None
        for batch in batches:
            arrow = batch.schema.field("id").type
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = _passages(text, k)
                    if len(found):
                        ids.append(key)
                        named.append(found)
                        n += len(found)
                if n >= CHUNK:
                    yield from packed(ids, named, arrow)
                    ids, named, n = [], [], 0
        if n:
            yield from packed(ids, named, arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, arrow = [], [], None
        for batch in batches:
            arrow = batch.schema.field("ids").type.value_type
            known = batch.filter(batch.column("found"))
            if known.num_rows:
                yield listed([x[0] for x in known.column("ids").to_pylist()], [np.frombuffer(x, "u4") for x in known.column("data").to_pylist()], arrow)
            rest = batch.filter(pc.invert(batch.column("found")))
            for own, data in zip(rest.column("ids").to_pylist(), rest.column("data").to_pylist(), strict=True):
                n = len(data) // 20
                h, g, place, at = (np.frombuffer(data, t, n, o * n) for t, o in (("<u8", 0), ("<u4", 8), ("<u4", 12), ("<u4", 16)))
                held.append((h, g, place + np.uint32(len(ids)), at))
                ids += own
        if not held:
            return
        h, g, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, starts = _groups(h, g)
        doc, at = doc[order], at[order]
        twice = at >> np.uint32(31) > 0
        counts = np.diff(np.r_[starts, len(order)])
        repeated = np.repeat((counts > 1) | np.logical_or.reduceat(twice, starts), counts) & ~twice
        found = list(_by_document(doc[repeated], at[repeated]))
        for i in range(0, len(found), 4096):
            yield listed([ids[d] for d, _ in found[i : i + 4096]], [x for _, x in found[i : i + 4096]], arrow)

    def listed(keys: list, places: list[np.ndarray], arrow: pa.DataType) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, places)]).astype("i4")
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places).astype("i4")))], names=["id", "at"])

    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def runs(places: pa.Array) -> pa.Array:
        out = []
        for x in places:
            at = np.sort(x.values.to_numpy())
            first = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + k])
            last = np.r_[first[1:], len(at)] - 1
            out.append([{"start": a - 1, "stop": b - 1 + k} for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))

    met = rows.mapInArrow(send, sent).repartition(buckets, "bucket").mapInArrow(meet, T.StructType([T.StructField("id", kind), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    places = met.groupBy("id").agg(F.flatten(F.collect_list("at")).alias("at"))
    return places.select(F.col("id").alias(id_col), F.inline(runs("at")))


def outside(words: Column, spans: Column) -> Column:
    """The words that lie in none of the spans (array of start, stop: sorted, disjoint, from 0), a slice for each gap."""
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda r: F.array(r["start"].cast("int"), r["stop"].cast("int")))), F.array(F.size(words)))

    def gaps(e: Column) -> Column:
        starts = F.filter(e, lambda _, i: i % 2 == 0)
        stops = F.filter(e, lambda _, i: i % 2 == 1)
        return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda g: F.slice(words, g["a"] + 1, g["b"] - g["a"])))

    return bound(edges, gaps)


def remove_repeated_spans(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (white-space words joined by blanks) without repeated passages; documents left empty go. A null text is
    left out; ids should be distinct and not null."""
    spans = repeated_spans(docs, k, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(spans, id_col, "left").select(id_col, whitespace_words(F.col("__t")).alias("w"), "s")  # the text is shuffled, not its words
    kept = F.when(F.col("s").isNull(), F.col("w")).otherwise(outside(F.col("w"), F.col("s")))
    return rows.select(id_col, F.array_join(kept, " ").alias("text")).where("text != ''")


def occurrences(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, first: how often a literal occurs without overlap, and its first place (from 1, 0 if absent)."""
    n = (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit(pattern), F.lit("")))) / len(pattern)
    return docs.select(id_col, n.cast("long").alias("n"), F.instr(text_col, pattern).cast("long").alias("first"))


def positions(text: Column, pattern: str) -> Column:
    """Every place (from 1) of a literal in a text, overlapping ones too, ascending; of a null text none."""

    @F.pandas_udf("array<long>")
    def find(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[int]:
            out, at = [], (t or "").find(pattern)
            while at >= 0:
                out.append(at + 1)
                at = t.find(pattern, at + 1)
            return out

        return s.map(one)

    return find(text)


def suffix_range(data: bytes, order: list[int], pattern: bytes) -> tuple[int, int]:
    """The part of a suffix array whose suffixes begin with ``pattern``: order[lo:hi] are its places."""
    head = lambda i: data[i : i + len(pattern)]
    return bisect_left(order, pattern, key=head), bisect_right(order, pattern, key=head)


def suffix_array(text: Column) -> Column:
    """Places of all suffixes of the UTF-8 bytes in order. For single strings; a corpus uses ``repeated_spans``."""

    @F.pandas_udf("array<int>")
    def build(s: pd.Series) -> pd.Series:
        def one(t: str) -> list[int]:
            data = t.encode("utf-8")
            n, rank, step = len(data), list(data), 1
            order = sorted(range(n), key=lambda i: data[i])
            while n and step < n:
                key = lambda i: (rank[i], rank[i + step] if i + step < n else -1)  # noqa: B023, E731
                order.sort(key=key)
                new, keys = [0] * n, [key(i) for i in order]
                for j in range(1, n):
                    new[order[j]] = new[order[j - 1]] + (keys[j] != keys[j - 1])
                rank = new
                if rank[order[-1]] == n - 1:
                    break
                step *= 2
            return order

        return s.map(lambda t: None if t is None else one(t))

    return build(text)
