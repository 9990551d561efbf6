"""The corpus pipeline: stages over documents, each of which reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import decontam, language_id, minhash_dedup, packing, pii
from chainloom.llm.common import Workspace, documents
from chainloom.llm.token_counts import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def accept_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the calibrated model is sure of; it learns from their labels."""
    model = language_id.fit(docs, F.lit(True))
    return docs.filter(language_id.predicted(model, F.col("text").cast("string"))["accepted"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 or more in common."""
    return minhash_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what gives it away replaced in their texts."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", accept_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", remove_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express none of the trained, sketched or packed stages; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written and read back."""
    docs, kept = documents(spark, sf_dir), Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept.table(docs, name)
    return docs
