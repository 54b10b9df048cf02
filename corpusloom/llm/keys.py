"""Row keys that treat a null id as a value, and joins of documents with per-document results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def text_of(col: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def id_keys(col: str, prefix: str) -> list[Column]:
    """Two non-null columns equal exactly where the ids are equal, nulls included."""
    return [F.coalesce(F.col(col), F.lit(0)).alias(f"{prefix}id"), F.col(col).isNull().alias(f"{prefix}no")]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has a column called so already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key that stands for more rows than this is first dealt out to tasks.
REPEATS = 1 << 16


def repeated(df: DataFrame, count: str, out: str, most: int = REPEATS, many: bool = True) -> DataFrame:
    """``count`` rows for each row, numbered from 0 in ``out``. With ``many``, counts above ``most`` occur: those rows
    are dealt out in runs of ``most``, so that no task makes all rows of a key. ``df`` should read written tables."""
    runs = lambda start, size: F.explode(F.sequence(start, start + size - 1)).alias(out)
    own = [F.col(c) for c in df.columns if c != count]
    few = df.where(F.col(count) <= most).select(*own, runs(F.lit(0).cast("long"), F.col(count)))
    if not many:
        return few
    start = fresh(df, "__start")
    dealt = df.where(F.col(count) > most).withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(most).cast("long"))))
    dealt = dealt.repartition(*(F.col(c) for c in dealt.columns))
    return few.union(dealt.select(*own, runs(F.col(start), F.least(F.col(count) - F.col(start), F.lit(most)))))


def keep_listed(docs: DataFrame, listed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs``, with all its columns, for each key in ``listed``: id, sha (SHA-256 of the text, binary) and
    n, how many rows have the key. ``listed`` has distinct keys and should read written tables; it may be as long as
    ``docs``, so it is joined by shuffle unless Spark finds it small."""
    a, b, c = (fresh(docs, x) for x in ("__kid", "__kno", "__ksha"))
    keyed = docs.withColumns({a: F.coalesce(F.col(id_col), F.lit(0)), b: F.col(id_col).isNull(), c: F.unhex(F.sha2(text_of(text_col), 256))})
    right = listed.select(F.coalesce("id", F.lit(0)).alias(a), F.col("id").isNull().alias(b), F.col("sha").alias(c))
    found = keyed.join(right, [a, b, c], "left_semi")
    if not listed.where("n > 1").isEmpty():
        found = found.dropDuplicates([a, b, c])
    return found.drop(a, b, c)
