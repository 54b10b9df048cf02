"""A training-data pipeline over ``documents``: five stages, each of which works on all that the one before kept.

toxicity: documents whose text scores 0.7 or more go; the classifier is fitted on a bounded sample of labelled rows.
exact_dedup: of equal texts the document with the largest id stays.
simhash: of each connected group of near copies (fingerprints within three bits) the document with the smallest id stays.
decontamination: documents that contain a benchmark item (0.8 of its five-word shingles) go.
packing: what is left is packed into sequences of 1024 tokens, a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontam import drop_contaminated
from corpusloom.llm.exact_dedup import drop_exact_copies
from corpusloom.llm.packing import packed
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.simhash import drop_near_copies
from corpusloom.llm.toxicity import drop_toxic
from corpusloom.plans.storage import finished


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash", simhash), ("decontamination", decontamination), ("packing", packing)]

#: A trained classifier has no SQL; tests/llm/test_pipeline.py holds every stage, and the whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again. What a stage
    writes on its way there is deleted when its result is whole, and the result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        result = finished(spark, lambda s=stage, d=docs: s(spark, d, sf_dir), name)
        if before:
            before.drop()
        docs, before = result.df, result
    return STAGES[-1][1](spark, docs, sf_dir)
