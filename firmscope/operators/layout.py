"""A second write layout for Gold: along a space-filling curve, with Bloom filters on the key.

The default layout prunes by state and date.  Here activity, city and opening date are
each coded by rank (into 2 ** bits ranges of about equal numbers of rows), the bits of
the three codes are interleaved, and the rows are cut into ranges of that number and
sorted by it.  Rows near in all three columns then lie in few row groups, so a filter on
any one of them skips most of the table, by Parquet's min/max statistics.  Keys are
spread all over: a Bloom filter for each row group answers look-ups of one company.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.operators.gold import read_gold_files

CURVE_COLUMNS = ("activity_code", "city_code", "opened_on")
BITS = 5
ROW_GROUP_BYTES = 16 << 20


def rank_cuts(df: DataFrame, columns: Sequence[str] = CURVE_COLUMNS, bits: int = BITS) -> dict[str, list[int]]:
    """Per column the values that cut it into 2 ** bits ranges: at most 2 ** bits - 1 numbers each, from one aggregation."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(_number(df, c), shares, 10_000).alias(c) for c in columns]).first()
    return {c: sorted(found[c] or []) for c in columns}  # a value that many rows share stands there several times: codes are ranks


def _number(df: DataFrame, column: str) -> Column:
    """A column as whole numbers: dates as days."""
    return F.unix_date(column) if df.schema[column].dataType.typeName() == "date" else F.col(column).cast("bigint")


def curve_key(df: DataFrame, cuts: dict[str, list[int]], bits: int = BITS) -> Column:
    """The interleaved bits of the columns' rank codes; a null counts as smaller than all values."""
    key = F.lit(0).cast("bigint")
    for place, (column, values) in enumerate(cuts.items()):
        number = _number(df, column)
        below = F.size(F.filter(F.array(*map(F.lit, values)), lambda cut: cut <= number)) if values else F.lit(0)
        code = F.when(number.isNull(), 0).otherwise(below)
        for bit in range(bits):
            taken = F.shiftright(code, bit).bitwiseAND(F.lit(1)).cast("bigint")
            key = key.bitwiseOR(F.shiftleft(taken, bit * len(cuts) + place))
    return key


def write_along_curve(df: DataFrame, path: str, companies: int | None = None, bits: int = BITS) -> None:
    """Write Gold in this layout.  ``companies``: about how many keys a row group has, for the Bloom filters' size."""
    cuts = rank_cuts(df, bits=bits)
    keyed = df.withColumn("_curve", curve_key(df, cuts, bits))
    # A row group is read whole, so small ones keep a look-up small.
    laid = keyed.repartitionByRange("_curve").sortWithinPartitions("_curve", *CURVE_COLUMNS).drop("_curve")
    (
        laid.write.option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.bloom.filter.enabled#company_id", "true")
        .option("parquet.bloom.filter.expected.ndv#company_id", str(companies or 200_000))
        .parquet(path)
    )


def look_up(spark: SparkSession, path: str, **values) -> DataFrame:
    """The rows with these values: ``look_up(spark, path, company_id="00000001")`` or ``city_code=7107``."""
    rows = read_gold_files(spark, path)
    for column, value in values.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows
