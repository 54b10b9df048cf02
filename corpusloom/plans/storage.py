"""Durable intermediate tables.

An iterative or multi-pass operator must not recompute its input from the start when an executor is lost, and its
passes must all see the same rows. ``stash`` writes a DataFrame as Parquet in the folder that the cluster names in
``spark.checkpoint.dir`` and returns a DataFrame that reads it back; the lineage ends at the files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of this machine, for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/corpusloom"


#: Paths handed out since each ``scratch`` block that is open began.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, at the end of the block, what was written to scratch paths inside it. Results that read such tables must
    be written elsewhere by then; a path taken off the list stays. Without such a block everything stays until somebody
    deletes the application's folder, since a lazy result may still need it."""
    own: list[str] = []
    _OPEN.append(own)
    try:
        yield own
    finally:
        _OPEN.pop()  # blocks end in the order that nests them
        for path in own:
            delete(spark, path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> Stash:
    """Write what ``make()`` gives, and delete the tables that were written on the way there."""
    with scratch(spark) as own:
        result = Stash(make(), label)
        own.remove(result.path)
    if _OPEN:
        _OPEN[-1].append(result.path)
    return result


class Stash:
    """A written table: ``df`` reads it, ``drop()`` deletes its files once nothing needs them.

    ``short``: a row or so per task, as of a list of files. It is written by one task, so that the others need not each
    write a file of one row.
    """

    def __init__(self, df: DataFrame, label: str = "stash", short: bool = False):
        spark = df.sparkSession
        df = df.repartition(1) if short else df
        self.path = scratch_path(spark, label)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.df.sparkSession, self.path)


def stash(df: DataFrame, label: str = "stash") -> DataFrame:
    return Stash(df, label).df


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Inputs of at most so many bytes are dealt out anew where they come from fewer files than there are cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is small and comes from few files, each of which one task would read alone.
    Larger inputs, and those of many files, are left as they are: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(df.inputFiles()) < cores
    small = few and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small else df


def once(df: DataFrame, name: str, value: Column, *keep: str | Column) -> DataFrame:
    """``keep`` and ``value``, computed once a row. A plain column of a Python function is computed again by a filter on it,
    which the optimiser moves below it, and by a second Python function of its result, which would hold the first one."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))
