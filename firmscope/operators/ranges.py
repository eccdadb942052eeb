"""Running sums and ranks over a whole table, without a window in one task.

The rows are cut into ranges of the order, each range is ordered by itself, and what
the ranges before it add up to (one number for each range and group) is joined back.
The ranges are written to the shared folder first: both passes must see the same cuts,
also when an executor is lost between them.  Rows of one place in the order are always
in one range, so a value that a third of the rows share makes one large range, which
the sort spills; it is never held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.session import shared_dir

PART = "_range"


def cut_into_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range in ``order``, stored."""
    path = f"{shared_dir(df.sparkSession)}/firmscope-scratch/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _with_offsets(ranges: DataFrame, group: Sequence[str], size: Column, inner: Column, name: str) -> DataFrame:
    """``inner`` (a window within a range) plus the sizes of the ranges before, per group."""
    sizes = ranges.groupBy(PART, *group).agg(size.alias("_size"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_of_{c}") for c in (PART, *group)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (PART, *group)]
    rows = ranges.withColumn("_inner", inner).join(offsets, same)
    return rows.withColumn(name, F.col("_inner") + F.col("_offset")).drop("_inner", "_offset", "_size", PART, *[f"_of_{c}" for c in (PART, *group)])


def dense_ranks(df: DataFrame, order: Sequence[Column], name: str = "place", group: Sequence[str] = ()) -> DataFrame:
    """The rows with their dense rank in ``order``, from 1, within each group.

    Rows that ``order`` doesn't tell apart share a rank.  An empty table stays empty.
    """
    ranges = cut_into_ranges(df, [*[F.col(c) for c in group], *order])
    within = Window.partitionBy(PART, *group).orderBy(*order)
    ranked = ranges.withColumn("_rank", F.dense_rank().over(within).cast("bigint"))
    return _with_offsets(ranked, group, F.max("_rank"), F.col("_rank"), name).drop("_rank")


def running_sums(df: DataFrame, order: Sequence[Column], value: Column, name: str = "running_total", group: Sequence[str] = ()) -> DataFrame:
    """The rows with the sum of ``value`` up to and with them, in ``order`` within each group.

    ``order`` must tell the rows of a group apart, else the sums of equal rows may be
    exchanged.  Null values count as 0.
    """
    ranges = cut_into_ranges(df.withColumn("_value", F.coalesce(value, F.lit(0))), [*[F.col(c) for c in group], *order])
    within = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_offsets(ranges, group, F.sum("_value"), F.sum("_value").over(within), name).drop("_value")
