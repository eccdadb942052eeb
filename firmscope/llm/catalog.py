"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmscope.llm import bpe, collocations, exact_dedup, html_text, line_dedup, minhash_dedup, mixing, quality, secrets, spotsigs, token_alignment, toxicity, warc_zip
from firmscope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_packages(table(spark, sf_dir, "pages"))
    return (
        warc_zip.read_packages(manifest)
        .withColumnRenamed("record_id", "page_id")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.poisson_mix(documents, mixing.temperature_weights(documents), keep_details=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_edited(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_warc_zip,
    op2_exact_dedup,
    op3_mixing,
    op4_toxicity,
    op5_bpe,
    op6_minhash,
    op7_spotsigs,
    op8_lines,
    op9_secrets,
    op10_quality,
    op11_html,
    op12_alignment,
    op13_collocations,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip": warc_zip.ORACLE_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL}
