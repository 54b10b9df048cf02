"""Ranks and running sums over a whole table without one task that holds it.

Rows are range-partitioned, so partition p precedes partition p+1. Each task numbers its own rows; what is gathered
afterwards is a row per partition and group, and the numbers are shifted by a join with those few totals. The sorted
rows are written once in between, so that both passes see the same partitions whatever is lost and computed anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.plans.storage import stash

PART, AT = "__part", "__at"


def range_sorted(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in global order of ``keys``: partition by partition, and sorted within each. Without a number of partitions,
    small neighbours may be merged at run time, so a short table costs few tasks and files."""
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def numbered_within(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Add ``out``: the row's place (from 0) among the rows of its ``group`` value, in the given order.

    ``group`` is a non-null integer column. Equal groups may span partitions, so a group that holds a third of all
    rows is shared by a third of the tasks. The joined totals have at most a row per partition and group.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(AT, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(group).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            at = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
            if values[0] == last:
                head = starts[1] if len(starts) > 1 else n
                at[:head] += seen
            last, seen = values[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, "i4")), pa.array(at.astype("i8"))],
                names=[*batch.schema.names, PART, AT],
            )

    done = stash(range_sorted(df, [group, *order]).mapInArrow(number, schema), "numbered")
    totals = done.groupBy(group, PART).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(group).alias("__g"), F.col(PART).alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # Neighbouring partitions share at most one group, so this table has fewer rows than partitions plus groups.
    joined = done.join(F.broadcast(base), (F.col(group) == F.col("__g")) & (F.col(PART) == F.col("__p")))
    return joined.withColumn(out, F.col("__base") + F.col(AT)).drop("__g", "__p", "__base", PART, AT)


def numbered(df: DataFrame, order: list[str], out: str = "rank", first: int = 0) -> DataFrame:
    """Add ``out``: the row's place, from ``first`` on, in the given order of the whole table."""
    rows = numbered_within(df.withColumn("__all", F.lit(0)), "__all", order, out)
    return rows.withColumn(out, F.col(out) + first).drop("__all")


def running_sums(df: DataFrame, order: list[str], value: str, out: str = "before", group: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows (of the same ``group`` value) that come before in the given order.

    ``order`` should tell all rows apart. A group that holds most rows is shared by the tasks of its range.
    """
    by = [group] if group else []
    done = stash(range_sorted(df, [*by, *order]).withColumn(PART, F.spark_partition_id()), "running")
    totals = done.groupBy(*by, PART).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate([*by, PART])], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate([*by, PART])]
    own = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = done.join(F.broadcast(base), same)  # a row per partition and group
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop(PART, "__base", *[f"__b{i}" for i in range(len(same))])
