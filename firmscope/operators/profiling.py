"""Profiling and chart data: capital by legal nature and by band (C2, C3, A18),
schema description and small previews (S14-S16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope import schemas
from firmscope.functions.clean import (
    activity_division,
    capital_band_index,
    format_money_br,
    label_fallback,
)
from firmscope.operators.regions import division_label


def capital_with_legal_nature(companies: DataFrame, ref_legal_nature: DataFrame) -> DataFrame:
    """Positive capital with the legal-nature description; unmapped rows are
    dropped (inner lookup, J4)."""
    pos = companies.where(F.col("share_capital") > 0).select("legal_nature_code", "share_capital")
    return pos.join(ref_legal_nature, pos.legal_nature_code == ref_legal_nature.code, "inner").select(
        F.col("description").alias("legal_nature"), "share_capital"
    )


def capital_by_legal_nature(
    companies: DataFrame, ref_legal_nature: DataFrame, n: int = 10
) -> DataFrame:
    """Legal natures with the highest mean capital (C2, top ``n``).

    Capital is first summed per code, so the lookup join sees one row per code.
    """
    pos = companies.where(F.col("share_capital") > 0)
    per_code = pos.groupBy("legal_nature_code").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("share_capital").alias("_s")
    )
    named = per_code.join(
        ref_legal_nature, per_code.legal_nature_code == ref_legal_nature.code, "inner"
    )
    per_name = named.groupBy(F.col("description").alias("legal_nature")).agg(
        F.round(F.sum("_s").cast("decimal(28,2)") / F.sum("_n"), 2).alias("mean_capital")
    )
    return per_name.orderBy(F.col("mean_capital").desc(), F.col("legal_nature")).limit(n)


def capital_bands(
    companies: DataFrame,
    ref_legal_nature: DataFrame,
    scale: float = 1.0,
    labels: Sequence[str] = schemas.CAPITAL_BAND_LABELS,
) -> DataFrame:
    """Companies per capital band, empty bands shown with 0.

    Band edges are ``CAPITAL_BAND_EDGES`` times ``scale``.  Both sides of the
    final join have at most one row per band.
    """
    spark = companies.sparkSession
    edges = [e * scale for e in schemas.CAPITAL_BAND_EDGES]
    rows = capital_with_legal_nature(companies, ref_legal_nature)
    counts = (
        rows.select(capital_band_index(F.col("share_capital"), edges).alias("band_index"))
        .where(F.col("band_index").isNotNull())
        .groupBy("band_index")
        .agg(F.count(F.lit(1)).alias("companies"))
    )
    bands = spark.createDataFrame(
        [(i + 1, label) for i, label in enumerate(labels)], "band_index int, band string"
    )
    return bands.join(counts, "band_index", "left").select(
        "band_index", "band", F.coalesce(F.col("companies"), F.lit(0).cast("bigint")).alias("companies")
    )


def describe_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column name, type and 1-based position of a table (S14).  Reads only
    the schema, never the rows."""
    rows = [(f.name, f.dataType.simpleString(), i + 1, f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, data_type string, position int, nullable boolean")


def _as_value(field: T.StructField) -> Column:
    """A text that is equal for equal values of the column and no others."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 equals 0.0
    return c.cast("string")


def profile_columns(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """Per column: position, type, nulls, distinct values, smallest and largest (as text).

    Nulls and ends are one plain aggregation.  Distinct values are exact: the rows
    become (position, value) pairs that are combined map-side, so a column of few
    values shuffles few rows, and the pairs are counted per column.  With
    ``distinct="sketch"`` they are estimated by a mergeable sketch (HyperLogLog, about
    1.6 % standard error) in the same aggregation as the ends, without that shuffle.
    """
    if distinct not in ("exact", "sketch"):
        raise ValueError(f"distinct must be exact or sketch, not {distinct}")
    fields = df.schema.fields
    stats = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"),
            *([F.hll_sketch_estimate(F.hll_sketch_agg(_as_value(f))).alias("distinct_values")] if distinct == "sketch" else []),
            F.min(f"`{f.name}`").cast("string").alias("smallest"),
            F.max(f"`{f.name}`").cast("string").alias("largest"),
        )
        for i, f in enumerate(fields)
    ]
    ends = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    if distinct == "sketch":
        return ends.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint")))
    pairs = [F.struct(F.lit(i + 1).alias("position"), _as_value(f).alias("value")) for i, f in enumerate(fields)]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    counts = values.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_values"))
    return ends.join(counts, "position", "left").select(
        "position", "column_name", "data_type", "nulls", F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values"),
        "smallest", "largest",
    )


def preview_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows in the order of every column (S15): deterministic."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]).limit(n)


def distinct_sample(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` smallest distinct values of a column."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(n)


def capital_by_state_text(companies: DataFrame) -> DataFrame:
    """Total capital per state with a Brazilian-formatted text."""
    return (
        companies.groupBy("state")
        .agg(F.sum("share_capital").alias("total_capital"))
        .withColumn("total_capital_text", format_money_br(F.col("total_capital"), 2))
    )


def activity_labels(companies: DataFrame, ref_activity: DataFrame, prefix: str = "CNAE ") -> DataFrame:
    """Every activity code in use with its display label: description, else
    ``prefix || code`` (P15)."""
    codes = companies.groupBy("activity_code").agg(F.count(F.lit(1)).alias("companies"))
    return codes.join(ref_activity, codes.activity_code == ref_activity.code, "left").select(
        "activity_code", label_fallback(F.col("description"), F.col("activity_code"), prefix).alias("label"), "companies"
    )


def division_profile(companies: DataFrame, pad: int | None = 7) -> DataFrame:
    """Companies per activity division with its short label."""
    return (
        companies.where(F.col("activity_code").isNotNull())
        .groupBy(activity_division(F.col("activity_code"), pad).alias("division"))
        .agg(F.count(F.lit(1)).alias("companies"))
        .withColumn("label", division_label(F.col("division")))
    )

