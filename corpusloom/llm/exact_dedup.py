"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. All blocks of the corpus are sorted and equal ones get one
integer name; then the names of adjacent blocks are paired and the pairs are named in the same way, level by level,
until each document has a single name. Names are given by comparing contents, never by hash alone, so two documents
share an identity exactly if their bytes are equal.

Sorting is by a range partition on (hash, doc_id, position) and, within a task, on (hash, content). A block that
makes up a third of the corpus is therefore spread over a third of the tasks. Only a hash run that crosses a partition
boundary can be named twice; each task reports the contents of its first and last run (a row or two per partition),
and those few names are unified by content. The blocks are shuffled once; all later rows are integers. Partitions are
left to Spark to merge, so a level with few pairs costs a task or two and a file or two, not one for each partition.

A row needs no number of its own: rows that repeat both id and text have the same blocks, so they are carried as one
key (id, SHA-256 of the text) with a count, and are told apart again in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.llm.keys import REPEATS, keep_listed, repeated, text_of
from corpusloom.plans.storage import Stash

BLOCK_BYTES = 8192
_CARRIED = {"id": pa.int64(), "sha": pa.binary(), "pos": pa.int32(), "blocks": pa.int32(), "n": pa.int64()}
_NAMED = "id long, sha binary, pos int, blocks int, n long, name long, h long, content binary"


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct (h, content) of a sorted partition; at the end, tell the first and the last run of h."""
    schema = pa.schema([*_CARRIED.items(), ("name", pa.int64()), ("h", pa.int64()), ("content", pa.binary())])
    base, last, first_h, first, run = TaskContext.get().partitionId() << 40, None, None, {}, {}
    top = base - 1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, content = batch.column("h").to_numpy(), batch.column("content")
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = (h[1:] != h[:-1]) | pc.not_equal(content.slice(1), content.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != (h[0], content[0].as_py())
        names = top + np.cumsum(new)
        starts = np.flatnonzero(new)
        first_h = h[0] if first_h is None else first_h
        for i in starts[h[starts] == first_h]:
            first[int(names[i])] = (first_h, content[int(i)].as_py())
        if last is None or last[0] != h[-1]:
            run = {}
        for i in starts[h[starts] == h[-1]]:
            run[int(names[i])] = (h[-1], content[int(i)].as_py())
        top, last = int(names[-1]), (h[-1], content[n - 1].as_py())
        none = pa.nulls(n)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _CARRIED] + [pa.array(names), none.cast(pa.int64()), none.cast(pa.binary())], schema=schema)
    if ends := first | run:
        rows = [(None, None, -1, 0, 0, name, int(hh), c) for name, (hh, c) in ends.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _named(rows: DataFrame) -> tuple[Stash, DataFrame]:
    """rows: id, sha, pos, blocks, n, h, content. Gives id, sha, pos, blocks, n, name."""
    spread = rows.select(*_CARRIED, "h", "content").repartitionByRange("h", "id", "pos")
    done = Stash(spread.sortWithinPartitions("h", "content", "id", "pos").mapInArrow(_name_sorted, _NAMED), "names")
    same = Window.partitionBy("h", "content")
    ends = done.df.where("pos = -1").select("name", F.min("name").over(same).alias("canon")).where("name != canon")
    # At most two runs per partition end up here, so the broadcast table has fewer rows than twice the partitions.
    rest = done.df.where("pos >= 0").select(*_CARRIED, "name")
    return done, rest.join(F.broadcast(ends), "name", "left").select(*_CARRIED, F.coalesce("canon", "name").alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, sha, level, name, n)``: (level, name) is equal for two rows exactly if their texts are equal.

    sha is the SHA-256 of the UTF-8 text; n is how many rows have this id and this text. Null texts count as empty; a
    null id is an id like any other.
    """
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("data"))
    data = data.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(block_bytes))).cast("int"))
    cut = data.select("id", F.unhex(F.sha2("data", 256)).alias("sha"), "blocks", F.lit(1).cast("long").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.col("data").substr(i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "content"))
    held, named = _named(cut.withColumn("h", F.xxhash64("content")))
    tables, finished, level = [held], [], 0
    while True:
        finished.append(named.where("blocks = 1").select("id", "sha", F.lit(level).alias("level"), "name", "n"))
        more = named.where("blocks > 1")
        if more.isEmpty():
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        # Every pair has a left block, so the rows of a key are counted by their left blocks.
        rows = F.sum(F.when(F.col("pos") % 2 == 0, F.col("n"))).alias("n")
        pairs = more.groupBy("id", "sha", "blocks", F.shiftright("pos", 1).cast("int").alias("p")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"), rows)
        pairs = pairs.select("id", "sha", F.col("p").alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"), "n", F.xxhash64("l", "r").alias("h"), F.encode(F.concat_ws(":", "l", "r"), "UTF-8").alias("content"))
        held, named = _named(pairs)
        tables.append(held)
        level += 1
    out = finished[0]
    for x in finished[1:]:
        out = out.union(x)
    done = Stash(out.groupBy("id", "sha", "level", "name").agg(F.sum("n").alias("n")), "identities")
    for x in tables:
        x.drop()
    return done.df


def _classes(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The keys (id, sha, level, name, n), and of each text (level, name) the keep_id and group_size."""
    ids = identities(docs, id_col, text_col, block_bytes)
    return ids, Stash(ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")), "groups").df


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays (a null id is less than any other); of several rows with
    that id one stays, and the others have ``kept`` false. Repeated rows count and are returned each; rows that share an
    id and have different texts are rows of different groups. Null texts are empty texts. An empty table gives an
    empty result. Other columns of ``docs`` are not looked at.
    """
    ids, groups = _classes(docs, id_col, text_col, block_bytes)
    joined = ids.join(groups, ["level", "name"])
    each = repeated(joined, "n", "copy", many=not ids.where(F.col("n") > REPEATS).isEmpty())
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return each.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, that of the largest id; all columns stay as they are.

    Null texts count as empty and keep their null; a null id is less than any other. Of rows that repeat the largest id
    one stays (any of them, should other columns differ). An empty table stays empty; columns of any name may be there.
    """
    ids, groups = _classes(docs, id_col, text_col, BLOCK_BYTES)
    kept = ids.join(groups, ["level", "name"]).where(F.col("id").eqNullSafe(F.col("keep_id")))
    return keep_listed(docs, kept.select("id", "sha", "n"), id_col, text_col)
