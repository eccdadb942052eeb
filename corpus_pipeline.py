"""The corpus pipeline: each stage works on all that its predecessor kept.

Stages, in this order: quality classifier, exact deduplication, MinHash
near-deduplication, mixing of sources to target weights, BPE encoding.  Every
stage is written to the shared folder as Parquet and read again by the next.

Defined cases, for every stage: a null text counts as empty; null and repeated ids are
no exception, rows are told apart by what they hold; an empty table gives an empty
result; extra columns are carried by all stages but the last, which gives ids and
token figures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmscope.llm import bpe, exact_dedup, minhash_dedup, mixing, quality
from firmscope.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject.

    Labels of null ids count for nothing; with labels of one class only, or none, nothing is rejected.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; empty and null texts are one group."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest id's,
    null ids last; documents without words all stay."""
    return minhash_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in proportion to the square roots of their sizes, as many documents as before on average.

    A null source is a source; rows of one id are drawn alike.
    """
    return mixing.poisson_mix(docs, mixing.temperature_weights(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the round trip's hashes; an empty text has none."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Training and near-duplicate search can't be expressed in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
