"""Published metrics over the Gold table (M1-M9), capital statistics (A2) and
data-quality reports (G8, G9).

All of them are single aggregations; where a lookup is involved the table is
first reduced to one row per code.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.functions.clean import _date_lit, activity_division, pct, severity_badge
from firmscope.operators.aggregates import mean_money, to_years, years_mean
from firmscope.operators.marts import closed_durations


def universe_stats(companies: DataFrame) -> DataFrame:
    """Number of companies, oldest and newest opening date (M1)."""
    return companies.agg(
        F.count(F.lit(1)).alias("companies"),
        F.min("opened_on").alias("oldest"),
        F.max("opened_on").alias("newest"),
    )


def _days_summary(days: DataFrame, count_name: str | None = None, with_max: bool = True) -> DataFrame:
    """Mean, median, p90 (and max) in years of a ``days`` column.

    The rows are first reduced to ``days -> n`` (a distributed, map-side
    combined aggregation); the single final aggregate then merges at most one
    entry per distinct day count (about 46 000 since 1900), however many rows
    or partitions there are.
    """
    per_day = days.groupBy("days").agg(F.count(F.lit(1)).alias("n"))
    aggs = [
        years_mean(F.col("days"), 1, weight=F.col("n")).alias("mean"),
        F.percentile(F.col("days"), [0.5, 0.9], F.col("n")).alias("_p"),
        F.max("days").alias("_max"),
    ]
    if count_name:
        aggs.insert(0, F.sum("n").alias(count_name))
    out = [count_name] if count_name else []
    out += [
        "mean",
        to_years(F.col("_p")[0], 1).alias("median"),
        to_years(F.col("_p")[1], 1).alias("p90"),
    ]
    if with_max:
        out.append(to_years(F.col("_max"), 1).alias("max"))
    # days is null only when the opening date is; those rows are ignored like in avg()
    return per_day.where(F.col("days").isNotNull()).agg(*aggs).select(*out)


def _age_summary(days: DataFrame) -> DataFrame:
    return _days_summary(days)


def age_active(companies: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Age in years of active companies at ``as_of``: mean, median, p90, max (M2)."""
    days = companies.where(F.col("status_code") == schemas.STATUS_ACTIVE).select(
        F.datediff(_date_lit(as_of), F.col("opened_on")).alias("days")
    )
    return _age_summary(days)


def age_all(companies: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Age in years of every company at ``as_of`` (M3)."""
    days = companies.select(F.datediff(_date_lit(as_of), F.col("opened_on")).alias("days"))
    return _age_summary(days)


def zero_capital_share(companies: DataFrame) -> DataFrame:
    """Companies with zero capital and their percentage (M4)."""
    return companies.agg(
        F.count_if(F.col("share_capital") == 0).alias("companies"),
        pct(F.count_if(F.col("share_capital") == 0), F.count(F.lit(1)), 1).alias("pct"),
    )


def sector_prefix_share(companies: DataFrame, prefix: str = "47", pad: int | None = 7) -> DataFrame:
    """Companies whose activity division equals ``prefix`` and their share (M5).

    One pass with a conditional count replaces the scalar sub-query for the total.
    """
    hit = activity_division(F.col("activity_code"), pad) == F.lit(prefix)
    return companies.agg(
        F.count_if(hit).alias("companies"),
        pct(F.count_if(hit), F.count(F.lit(1)), 1).alias("pct"),
    )


def status_label(code: Column) -> Column:
    mapping = F.create_map(*[x for k, v in schemas.STATUS_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(mapping[code], code.cast("string"))


def status_distribution(companies: DataFrame) -> DataFrame:
    """Companies per registry status with percentage and label (M6).

    The share uses an un-partitioned window, which is safe because it runs on
    the grouped result (one row per status code, a handful of rows).
    """
    grouped = companies.groupBy("status_code").agg(F.count(F.lit(1)).alias("companies"))
    total = F.sum("companies").over(Window.partitionBy())
    return grouped.select(
        "status_code",
        status_label(F.col("status_code")).alias("label"),
        "companies",
        pct(F.col("companies"), total, 1).alias("pct"),
    )


def survival_global(companies: DataFrame) -> DataFrame:
    """Closed companies with usable dates: n, mean, median, p90 in years (M7)."""
    summary = _days_summary(closed_durations(companies).select("days"), "closed", with_max=False)
    return summary.select(F.coalesce(F.col("closed"), F.lit(0).cast("bigint")).alias("closed"), "mean", "median", "p90")


def state_openings_by_year(
    companies: DataFrame, state: str, since: str | dt.date = "2015-01-01"
) -> DataFrame:
    """Openings per year in one state since a date (M8)."""
    return (
        companies.where((F.col("state") == F.lit(state)) & (F.col("opened_on") >= _date_lit(since)))
        .groupBy(F.year("opened_on").alias("year"))
        .agg(F.count(F.lit(1)).alias("companies"))
    )


def decade_of(d: Column) -> Column:
    """The year without its last digit, in whole numbers."""
    return F.year(d) - F.year(d) % F.lit(10)


def decade_distribution(companies: DataFrame) -> DataFrame:
    """Companies per opening decade with percentage (M9)."""
    grouped = companies.groupBy(decade_of(F.col("opened_on")).alias("decade")).agg(
        F.count(F.lit(1)).alias("companies")
    )
    total = F.sum("companies").over(Window.partitionBy())
    return grouped.select("decade", "companies", pct(F.col("companies"), total, 1).alias("pct"))


def capital_stats(companies: DataFrame) -> DataFrame:
    """Count, sum, max and mean of positive capital (A2 / report statistics)."""
    pos = companies.where(F.col("share_capital") > 0)
    return pos.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("share_capital").alias("sum_capital"),
        F.max("share_capital").alias("max_capital"),
        mean_money(F.col("share_capital")).alias("mean_capital"),
    )


def data_quality_report(
    companies: DataFrame,
    ref_activity: DataFrame,
    as_of: str | dt.date,
    date_floor: str | dt.date = "1800-01-01",
) -> DataFrame:
    """One-row quality report: invalid capital, invalid date, unmapped activity,
    each with its percentage of all rows and a severity badge (G8).

    The table is reduced to one row per activity code in the same pass that
    counts the invalid values; the lookup (de-duplicated, so repeated codes do
    not inflate counts) is then joined on that small result.
    """
    per_code = companies.groupBy("activity_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("share_capital").isNull() | (F.col("share_capital") <= 0)).alias("bad_cap"),
        F.count_if(
            F.col("opened_on").isNull()
            | (F.col("opened_on") < _date_lit(date_floor))
            | (F.col("opened_on") > _date_lit(as_of))
        ).alias("bad_date"),
    )
    codes = ref_activity.select(F.col("code").alias("_code")).distinct()
    joined = per_code.join(codes, per_code.activity_code == codes._code, "left")
    summary = joined.agg(
        F.sum("n").alias("total"),
        F.sum("bad_cap").alias("invalid_capital"),
        F.sum("bad_date").alias("invalid_date"),
        F.sum(F.when(F.col("_code").isNull(), F.col("n")).otherwise(0)).alias("unmapped_activity"),
    )
    out = [F.col("total")]
    for name in ("invalid_capital", "invalid_date", "unmapped_activity"):
        p = pct(F.col(name), F.col("total"), 2)
        out += [F.col(name), p.alias(f"pct_{name}"), severity_badge(F.coalesce(p, F.lit(0.0))).alias(f"badge_{name}")]
    return summary.select(*out)


def unmapped_codes(companies: DataFrame, ref_activity: DataFrame) -> DataFrame:
    """Activity codes present in the table but missing from the lookup, with
    how many companies carry each (J5, as an anti-join on distinct codes)."""
    per_code = companies.where(F.col("activity_code").isNotNull()).groupBy("activity_code").agg(
        F.count(F.lit(1)).alias("companies")
    )
    return per_code.join(
        ref_activity.select(F.col("code")), per_code.activity_code == F.col("code"), "left_anti"
    )


def survival_discards(companies: DataFrame) -> DataFrame:
    """Closed companies left out of survival: no closing date, closing before
    opening, and the total closed (G9)."""
    closed = companies.where(F.col("status_code") == schemas.STATUS_CLOSED)
    return closed.agg(
        F.count_if(F.col("status_on").isNull()).alias("no_date"),
        F.count_if(F.col("status_on") < F.col("opened_on")).alias("inverted_date"),
        F.count(F.lit(1)).alias("total_closed"),
    )
