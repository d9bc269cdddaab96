"""Corpus pipeline: language, near duplicates, benchmark passages, source mix, training-order token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import decontaminate, language_id, mixing, simhash, token_shards
from quarrylens.llm.common import discard, stash


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as one of the labelled languages; text without letters or in none of them goes."""
    return language_id.fits_a_language(docs, language_id.references(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: near fingerprints first, then shingles, each link checked on the texts."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the source weights ask for."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token shards in training order; the rows are their index."""
    return token_shards.write_shards(docs)


STAGES = [("language_id", keep_languages), ("near_dedup", near_dedup), ("decontamination", drop_benchmark),
          ("mixing", mix_sources), ("token_output", token_output)]

#: The stages hash, draw and write files in ways that SQL cannot say; tests compare them with brute force.
ORACLE_SQL = None


#: Bytes of rows that a task hands to Python at once: they are held by the JVM and by the worker, in every task.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            docs = stash(made, name)
            discard(*getattr(made, "stashes", []))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(_BATCH, before)
