"""Exact, line-level and list-based duplicate removal.

Texts are hashed before any shuffle. "Keep the first" is a minimum with a partial aggregation, never a window over a
key, so a key that a third of the rows share is combined on the map side and its rows do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.filters import lines
from corpusloom.functions.normalize import normalize_classes
from corpusloom.operators.graph import connected_components


def first_of_each(df: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """``(order, key)`` of the first row of every key."""
    return df.select(key.alias("key"), order).groupBy("key").agg(F.min(order).alias(order))


def exact_hash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_func=F.md5) -> DataFrame:
    """Documents whose text no document with a smaller id has."""
    keep = first_of_each(docs, hash_func(F.col(text_col)), id_col).select(id_col)
    return docs.join(keep, id_col, "left_semi")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=normalize_classes, scope: str | None = None) -> DataFrame:
    """id, text: of equal normalised lines of the whole corpus (or of a ``scope`` value) the first stays, by id and
    place; documents that lose all lines go."""
    extra = [scope] if scope else []
    each = docs.select(id_col, *extra, F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    firsts = each.groupBy(*extra, F.md5(key(F.col("line"))).alias("k")).agg(F.min(F.struct(id_col, "pos")).alias("first"))
    kept = each.join(firsts.select(F.col(f"first.{id_col}").alias(id_col), F.col("first.pos").alias("pos")), [id_col, "pos"])
    back = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return back.select(id_col, F.array_join(F.col("l.line"), "\n").alias("text")).where("text != ''")


def without_known(docs: DataFrame, known: DataFrame, text_col: str = "text", known_col: str = "text") -> DataFrame:
    """Train documents whose SHA-256 is not that of a held-out text."""
    a = docs.withColumn("__h", F.sha2(text_col, 256))
    return a.join(known.select(F.sha2(known_col, 256).alias("__h")).distinct(), "__h", "left_anti").drop("__h")


def components_to_drop(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id: every member of a connected set but its least."""
    return connected_components(pairs, src, dst).where("node != component").select(F.col("node").alias("id"))


def drop_listed(docs: DataFrame, listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(listed.select(F.col(listed.columns[0]).alias(id_col)), id_col, "left_anti")


def unflagged(docs: DataFrame, flag: str = "duplicate") -> DataFrame:
    return docs.where(~F.coalesce(F.col(flag), F.lit(False)))


def duplicates_by_file(dropped: DataFrame, files: DataFrame, id_col: str = "doc_id", file: str = "source", row: str = "row") -> DataFrame:
    """file, n_rows, rows: per file the sorted rows to drop. ``dropped`` lists ids; ``files`` maps an id to file and row.

    A file's list is one row, so this is for lists that readers of single files want; a join needs no such list."""
    hit = files.join(dropped.select(F.col(dropped.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    return hit.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list(row)).alias("rows"))
