"""The corpus pipeline: five of the operators, each stage written as Parquet and read by the next."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mailtriage.llm import langid, line_dedup, mixing, packing, simhash
from mailtriage.session import bound_batches, checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    bound_batches(spark)
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats."""
    bound_batches(spark)
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by the operator's contract: 3-word shingles, 3 bits."""
    bound_batches(spark)
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece."""
    bound_batches(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("mix", mix), ("pack", pack)]

#: Compression sizes, tokenizer ids and XXH64 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
