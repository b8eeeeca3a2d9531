"""A training corpus in five stages; each works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, written as Parquet in the shared folder and read again. All but
the last return the columns of `documents`. SQL expresses neither the language model, the near-duplicate search nor the
packing, so ORACLE_SQL is None and the tests hold every stage's rows against brute force on a small fixture. Empty tables give
empty results, repeated rows are rows of their own, and extra columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchforge.llm import exact_dedup, minmax_dedup, mixing, packing, quality_lm
from matchforge.llm._common import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; null and empty texts stay, as nothing speaks against them."""
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays, also of null and empty ones."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups one row stays; texts without words stay all."""
    return minmax_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets; texts without words go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; null texts hold the end id only."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
