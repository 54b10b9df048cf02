"""Streaming duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def exact_within_watermark(stream: DataFrame, text_col: str, time_col: str, horizon: str = "1 day") -> DataFrame:
    """Rows whose text was not seen within the horizon; state is one hash per text and expires with the watermark."""
    keyed = stream.withColumn("__h", F.sha2(F.col(text_col), 256)).withWatermark(time_col, horizon)
    return keyed.dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def flag_against_table(stream: DataFrame, keys, table: str, out: str, checkpoint: str, id_col: str = "doc_id") -> StreamingQuery:
    """MinHash flags over a stream: each micro-batch is flagged against the key table at ``table`` and itself, flags go to
    ``out`` and new keys to the table. ``keys`` maps a batch to (id, band, key).

    Both are written under the batch's number and replaced if the batch runs again, so a restart repeats nothing.
    """
    from corpusloom.operators.minhash import flags_with_list

    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        own = keys(batch).persist()
        schema = "band int, key string, batch long"
        try:
            known = spark.read.schema(schema).parquet(table).where(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        flags_with_list(own, known.select("band", "key")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        own.select("band", "key").distinct().write.mode("overwrite").parquet(f"{table}/batch={number}")
        own.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
