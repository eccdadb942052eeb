"""Gold build: clean, quarantine and join the two raw files.

The result has one row per company: the company file is joined with the
head-office establishment whose opening date passes the quarantine predicate.
Both sides are reduced to the needed columns and filtered before the join, so
the shuffle carries only what the Gold table keeps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.functions.clean import (
    DEFAULT_DATE_FLOOR,
    QUARANTINE_REASONS,
    capital_unparsable,
    normalise_key,
    opening_date_ok,
    parse_code,
    parse_compact_date,
    parse_decimal_comma,
    parse_int,
    quarantine_reason,
)
from firmscope.schemas import GOLD_COLUMNS

HEAD_OFFICE = "1"


def company_key(raw: DataFrame, column: str = "cnpj_basico") -> Column:
    """The padded key of a raw table: stored as ``company_id`` where the table is kept by key, else computed."""
    return F.col("company_id") if "company_id" in raw.columns else normalise_key(F.col(column))


def head_offices(establishments_raw: DataFrame) -> DataFrame:
    return establishments_raw.where(F.col("matriz_filial") == F.lit(HEAD_OFFICE))


def quarantine_split(
    establishments_raw: DataFrame,
    as_of: str | dt.date,
    floor: str | dt.date = DEFAULT_DATE_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """Head-office rows split into (accepted, rejected).

    ``rejected`` keeps the normalised key, the raw opening date and a reason;
    a null date is rejected and counted (never silently dropped).
    """
    heads = head_offices(establishments_raw)
    ok = opening_date_ok(F.col("data_inicio_atividade"), as_of, floor)
    accepted = heads.where(ok)
    rejected = heads.where(~ok).select(
        normalise_key(F.col("cnpj_basico")).alias("company_id"),
        F.col("data_inicio_atividade").alias("raw_opened_on"),
        quarantine_reason(F.col("data_inicio_atividade"), as_of, floor).alias("reason"),
    )
    return accepted, rejected


def quarantine_count(
    establishments_raw: DataFrame,
    as_of: str | dt.date,
    floor: str | dt.date = DEFAULT_DATE_FLOOR,
) -> DataFrame:
    """Head-office rows that the quarantine will exclude (P8), one row."""
    ok = opening_date_ok(F.col("data_inicio_atividade"), as_of, floor)
    return head_offices(establishments_raw).agg(F.count_if(~ok).alias("quarantined"))


def quarantine_reasons(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def reason_counts() -> list[Column]:
    """Rejected rows per reason, as aggregates that a write can observe."""
    return [F.count_if(F.col("reason") == reason).alias(reason) for reason in QUARANTINE_REASONS]


def build_gold(
    companies_raw: DataFrame,
    establishments_raw: DataFrame,
    as_of: str | dt.date,
    floor: str | dt.date = DEFAULT_DATE_FLOOR,
) -> DataFrame:
    """Typed one-row-per-company table from the two raw files.

    Keys are zero-padded on both sides; codes become bigint (empty -> null);
    capital is parsed from decimal comma (unparsable -> 0); dates from
    ``yyyyMMdd`` (``'0'`` and impossible dates -> null).
    """
    accepted, _ = quarantine_split(establishments_raw, as_of, floor)
    comp = companies_raw.select(
        company_key(companies_raw).alias("company_id"),
        F.col("razao_social").alias("legal_name"),
        parse_code(F.col("natureza_juridica")).alias("legal_nature_code"),
        parse_decimal_comma(F.col("capital_social")).alias("share_capital"),
    )
    est = accepted.select(
        company_key(accepted).alias("company_id"),
        parse_compact_date(F.col("data_inicio_atividade")).alias("opened_on"),
        parse_code(F.col("cnae_fiscal")).alias("activity_code"),
        parse_code(F.col("municipio")).alias("city_code"),
        F.col("uf").alias("state"),
        parse_int(F.col("situacao_cadastral")).alias("status_code"),
        parse_compact_date(F.col("data_situacao")).alias("status_on"),
    )
    # Both sides hold one row per company: a shuffled sort-merge join by
    # design (AQE splits skewed partitions), never a broadcast of either.
    return comp.join(est.hint("merge"), "company_id", "inner").select(*GOLD_COLUMNS)


def capital_parse_report(companies_raw: DataFrame) -> DataFrame:
    """Rows whose capital text could not be parsed (they were set to 0, D8)."""
    return companies_raw.agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(capital_unparsable(F.col("capital_social"))).alias("unparsable_capital"),
        F.count_if(F.col("capital_social").isNull()).alias("null_capital"),
    )


def gold_layout(df: DataFrame) -> DataFrame:
    """Write layout standing in for the indexes of a row store.

    Rows are brought together by (state, opening year) with a ``rebalance``: at
    run time large partitions are split and small ones merged to the advisory
    size, without a number given beforehand and without sampling the input
    (which would run the join twice).  They are sorted by state and opening date
    inside each partition, so Parquet min/max statistics skip row groups for
    state filters (the regional queries) and for date filters within a state
    (the role of B-tree and BRIN indexes).  The positive-capital ranking is
    served by a per-partition top-k and needs no index.
    """
    by_year = df.withColumn("_year", F.year("opened_on")).hint("rebalance", F.col("state"), F.col("_year"))
    return by_year.sortWithinPartitions("state", "opened_on").drop("_year")


def write_gold(df: DataFrame, path: str) -> None:
    gold_layout(df).write.mode("overwrite").parquet(path)


def read_gold_files(spark, path: str, schema=None):
    """Read a Gold folder with its declared schema (partition values stay text)
    and the column order of the table."""
    from firmscope.schemas import GOLD

    schema = schema or GOLD
    return spark.read.schema(schema).parquet(path).select(*schema.names)
