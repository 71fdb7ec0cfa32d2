"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, byte-level BPE.

Every stage takes and returns the columns of ``documents`` (the last one returns token ids) and works on all that the
stage before it kept. Its result is written as Parquet to the shared folder and read again, so a lost executor never
repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glintscan.llm import byte_bpe, line_frequency, mixing, near_dedup, queries, secret_scan
from glintscan.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source share go, and so do documents that fail the rules or lose most of their words.

    One text keeps each line, so that a clean text with many copies is left for the next stage, which keeps one of them.
    """
    return line_frequency.clean(docs, spare_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return near_dedup.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weight of their source, each as often as the mix takes it."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), and the SHA-256 of what the ids decode to."""
    encoded = byte_bpe.encode(docs, queries.RANKS, queries.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("byte-level BPE", encoding),
]

#: Near-duplicate components and merges of a vocabulary are no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
