"""Pre-aggregated marts over the Gold ``companies`` table (V1-V6).

Each mart groups the full table once.  Wherever a lookup join is needed it is
done *after* a first aggregation on the code, so the join sees one row per
(code, group) instead of one row per company, and hot codes are combined
map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.functions.clean import activity_division, city_prefix, label_fallback, pct
from firmscope.operators.aggregates import mean_money, to_years, years_mean

SURVIVAL_POINTS = [0.5, 0.05, 0.25, 0.75, 0.95]
SURVIVAL_COLUMNS = ["median", "p05", "q1", "q3", "p95"]


def closed_durations(companies: DataFrame, *more: str) -> DataFrame:
    """Closed companies with a usable closing date: activity code, days of life and the columns ``more``."""
    return companies.where(
        (F.col("status_code") == schemas.STATUS_CLOSED)
        & F.col("status_on").isNotNull()
        & (F.col("status_on") >= F.col("opened_on"))
    ).select("activity_code", F.datediff("status_on", "opened_on").alias("days"), *more)


def survival_by_sector(
    companies: DataFrame, ref_activity: DataFrame, min_count: int = 1000
) -> DataFrame:
    """Years between opening and closing, per sector: n, mean and percentiles.

    The sector is the activity description (codes sharing a description are
    merged), else ``'CNAE ' || code``.  Sectors with fewer than ``min_count``
    closed companies are dropped.

    Plan: (code, days) -> count is pre-aggregated map-side, the lookup is
    joined on that small result, and the exact percentiles take the count as
    frequency, so no task ever holds the rows of one sector.
    """
    per_code_day = closed_durations(companies).groupBy("activity_code", "days").agg(
        F.count(F.lit(1)).alias("n")
    )
    return survival_of_lifetimes(per_code_day, ref_activity, min_count)


def survival_of_lifetimes(per_code_day: DataFrame, ref_activity: DataFrame, min_count: int = 1000) -> DataFrame:
    """``survival_by_sector`` from the histogram (activity_code, days, n)."""
    labelled = per_code_day.join(
        ref_activity, per_code_day.activity_code == ref_activity.code, "left"
    ).select(
        label_fallback(F.col("description"), F.col("activity_code"), "CNAE ").alias("sector"),
        "days",
        "n",
    )
    agg = (
        labelled.groupBy("sector")
        .agg(
            F.sum("n").alias("total"),
            years_mean(F.col("days"), 2, weight=F.col("n")).alias("mean"),
            F.percentile(F.col("days"), SURVIVAL_POINTS, F.col("n")).alias("_p"),
        )
        .where(F.col("total") >= F.lit(min_count))
    )
    return agg.select(
        "sector",
        "total",
        "mean",
        *[to_years(F.col("_p")[i], 2).alias(name) for i, name in enumerate(SURVIVAL_COLUMNS)],
    )


def city_year_counts(companies: DataFrame) -> DataFrame:
    """One aggregation that feeds both city marts and the regional series: per
    (opening year, city, state) the companies, and the count and sum of
    positive capital.

    The mart rebuild writes it first and derives growth and bubbles from the
    stored result, so Gold is scanned once for both.  State and city are
    independent raw fields: a city may occur under several states.
    """
    positive = F.when(F.col("share_capital") > 0, F.col("share_capital"))
    return (
        companies.where(F.col("opened_on").isNotNull() & F.col("city_code").isNotNull())
        .groupBy(F.year("opened_on").alias("year"), "city_code", "state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(positive).alias("n_positive"),
            F.sum(positive).alias("capital_positive"),
        )
    )


def growth_by_city(counts: DataFrame, ref_city: DataFrame, since_year: int = 1990) -> DataFrame:
    """Openings per (year, city) since 1 January of ``since_year``, with the city name (V2), from ``city_year_counts``."""
    c = counts.where(F.col("year") >= since_year).groupBy("year", "city_code").agg(F.sum("n").alias("total"))
    return c.join(ref_city, c.city_code == ref_city.code, "left").select(
        "year",
        "city_code",
        label_fallback(F.col("description"), F.col("city_code")).alias("city_name"),
        "total",
    )


def bubbles_year_city(counts: DataFrame, ref_city: DataFrame) -> DataFrame:
    """Companies and mean capital per (opening year, city), capital > 0 (V3), from ``city_year_counts``."""
    c = (
        counts.where(F.col("n_positive") > 0)
        .groupBy("year", "city_code")
        .agg(
            F.sum("n_positive").alias("total_companies"),
            F.sum("capital_positive").cast("decimal(28,2)").alias("_sum"),
        )
    )
    return c.join(ref_city, c.city_code == ref_city.code, "left").select(
        "year",
        "city_code",
        label_fallback(F.col("description"), F.col("city_code")).alias("city_name"),
        "total_companies",
        F.round(F.col("_sum") / F.col("total_companies"), 2).alias("mean_capital"),
    )


def sector_treemap(companies: DataFrame, pad: int | None = 7) -> DataFrame:
    """Companies and total capital per activity division (V4)."""
    return (
        companies.where((F.col("share_capital") >= 0) & F.col("activity_code").isNotNull())
        .groupBy(activity_division(F.col("activity_code"), pad).alias("activity_division"))
        .agg(
            F.count(F.lit(1)).alias("total_companies"),
            F.sum("share_capital").alias("total_capital"),
        )
    )


def region_column(region: str | Column = "state") -> Column:
    """Region key: a column name, ``'city_prefix2'`` (first two digits of the
    city code, as the original comparator did) or any Column expression."""
    if isinstance(region, Column):
        return region
    if region == "city_prefix2":
        return city_prefix(F.col("city_code"), 2)
    return F.col(region)


def region_kpis(companies: DataFrame, region: str | Column = "state") -> DataFrame:
    """Per region: companies, mean positive capital, percent active (V5)."""
    positive = F.when(F.col("share_capital") > 0, F.col("share_capital"))
    return companies.groupBy(region_column(region).alias("region")).agg(
        F.count(F.lit(1)).alias("total_companies"),
        mean_money(positive).alias("mean_capital"),
        pct(F.count_if(F.col("status_code") == schemas.STATUS_ACTIVE), F.count(F.lit(1)), 1).alias(
            "pct_active"
        ),
    )


def density_from_kpis(kpis: DataFrame) -> DataFrame:
    """``density_by_state`` from the regional KPIs by state."""
    return kpis.where(F.col("region").isNotNull()).select(F.col("region").alias("state"), F.col("total_companies").alias("total"))


def density_by_state(companies: DataFrame) -> DataFrame:
    """Companies per state, state known (V6)."""
    return (
        companies.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("total"))
    )

