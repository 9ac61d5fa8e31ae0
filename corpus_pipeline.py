"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

In every stage texts of any length are read whole, other columns pass unchanged whatever their names, and an empty
table gives an empty result. What happens to nulls, empty texts, ties and repeated rows stands at each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packlens.llm import decontaminate, exact_dedup, language_id, minhash, packing
from packlens.llm.common import scratch_root


#: Rows and bytes in one Arrow batch between Spark and its Python workers, for the session of the job: long texts make
#: batches of the default 10,000 rows and 64 MB the largest part of a worker's memory.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def _small_batches(spark: SparkSession) -> None:
    """Every stage asks for them, so that a stage may also be run alone; they are never put back, so that stages of
    several threads can't change each other's."""
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null and empty texts too), whose language can't be told, go; all others stay.
    Rows that share an id, or have none, go only if none of them has a letter."""
    _small_batches(spark)
    return language_id.drop_undetermined(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays. Null and empty texts are equal; rows that repeat the id that
    stays all stay, and so do rows of a group in which all ids are null."""
    _small_batches(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the smallest id of each group stays. Null and empty texts and rows
    without an id are like nothing and stay; rows that repeat the smallest id all stay."""
    _small_batches(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or a re-parameterised one, go. Null and empty texts and rows without
    an id stay; rows that share an id go together; an empty benchmark drops nothing."""
    _small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; each source in proportion to its tokens to the power 0.7. Null and empty texts are
    one id long; rows with null or repeated ids are documents of their own."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), temper=0.7)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of the table documents. Each stage's result is a table in the shared
    folder, which the next one reads; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
