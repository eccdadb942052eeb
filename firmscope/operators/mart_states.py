"""Marts kept up to date by difference: partial states that can be added and subtracted.

Every mart is a function of a small state, a keyed table of counts and exact sums:

* ``openings``: per (year, city, state) the companies, and the count and sum of positive capital;
* ``sectors``: per activity code the companies with known capital, and its sum;
* ``regions``: per state the companies, active ones, and the count and sum of positive capital;
* ``lifetimes``: per (activity code, days of life) the closed companies: a histogram, from
  which the percentiles follow exactly.

:func:`difference` compares two Gold versions on the columns that the states use and
keeps only the rows that came, went or changed, with a weight of 1 or -1 (a changed
company is one of each; repeated rows are counted, so the versions may be any
multisets).  For one state it compares that state's columns alone.  A state of the weighted rows is what the states differ by;
:func:`updated` adds it.  Sums are decimals and counts integers, so an updated state
equals the one built from the new version, row by row.  Groups that no company is left
in go.

The comparison reads both versions but hands on only what changed; the states of the
new version take nothing from the rows that stayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.functions.clean import activity_division, pct
from firmscope.operators import marts

#: The Gold columns that the states depend on.
USED = ["company_id", "share_capital", "opened_on", "activity_code", "city_code", "state", "status_code", "status_on"]
WEIGHT = "weight"


def whole(gold: DataFrame) -> DataFrame:
    """Every row of a Gold version, once."""
    return gold.select(*USED, F.lit(1).cast("bigint").alias(WEIGHT))


def difference(old: DataFrame, new: DataFrame, name: str | None = None) -> DataFrame:
    """The rows that the versions don't share, weighted: 1 for each that came, -1 for each that went.

    With the ``name`` of a state only the columns that it depends on are compared and
    kept: rows that are alike in them are one row with their number as weight, combined
    before the exchange.
    """
    columns = USED if name is None else STATES[name][1]
    both = whole(new).union(whole(old).withColumn(WEIGHT, -F.col(WEIGHT)))
    return both.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def _sum_if(condition: Column, value: Column | None = None) -> Column:
    weighted = F.col(WEIGHT) if value is None else (value * F.col(WEIGHT)).cast("decimal(38,2)")
    zero = F.lit(0).cast("bigint") if value is None else F.lit(0).cast("decimal(38,2)")
    return F.sum(F.when(condition, weighted).otherwise(zero))


def _positive() -> Column:
    return F.col("share_capital") > 0


def _openings(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("opened_on").isNotNull() & F.col("city_code").isNotNull()).groupBy(
        F.year("opened_on").alias("year"), "city_code", "state"
    ).agg(
        F.sum(WEIGHT).alias("n"),
        _sum_if(_positive()).alias("n_positive"),
        _sum_if(_positive(), F.col("share_capital")).alias("capital_positive"),
    )


def _sectors(rows: DataFrame) -> DataFrame:
    known = F.lit(True)
    return rows.where((F.col("share_capital") >= 0) & F.col("activity_code").isNotNull()).groupBy("activity_code").agg(
        F.sum(WEIGHT).alias("n"), _sum_if(known, F.col("share_capital")).alias("capital")
    )


def _regions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state").agg(
        F.sum(WEIGHT).alias("n"),
        _sum_if(F.col("status_code") == schemas.STATUS_ACTIVE).alias("n_active"),
        _sum_if(_positive()).alias("n_positive"),
        _sum_if(_positive(), F.col("share_capital")).alias("capital_positive"),
    )


def _lifetimes(rows: DataFrame) -> DataFrame:
    return marts.closed_durations(rows, WEIGHT).groupBy("activity_code", "days").agg(F.sum(WEIGHT).alias("n"))


#: Name -> (keys, Gold columns that it depends on, state of weighted rows).
STATES: dict[str, tuple[list[str], list[str], Callable[[DataFrame], DataFrame]]] = {
    "openings": (["year", "city_code", "state"], ["opened_on", "city_code", "state", "share_capital"], _openings),
    "sectors": (["activity_code"], ["activity_code", "share_capital"], _sectors),
    "regions": (["state"], ["state", "status_code", "share_capital"], _regions),
    "lifetimes": (["activity_code", "days"], ["activity_code", "status_code", "opened_on", "status_on"], _lifetimes),
}


def state_of(name: str, rows: DataFrame) -> DataFrame:
    """The state of weighted rows, one aggregation combined map-side."""
    return STATES[name][2](rows)


def updated(name: str, state: DataFrame, change: DataFrame) -> DataFrame:
    """The state after a change; both are states of this name.  Raises when a group would go below zero."""
    keys = STATES[name][0]
    measures = [c for c in state.columns if c not in keys]
    total = state.unionByName(change.select(*state.columns)).groupBy(*keys)
    total = total.agg(*[F.sum(m).cast(state.schema[m].dataType).alias(m) for m in measures])
    below = F.raise_error(F.lit(f"state {name}: a change takes away companies that the state doesn't have"))
    return total.withColumn("n", F.when(F.col("n") < 0, below.cast("bigint")).otherwise(F.col("n"))).where(F.col("n") != 0)


# --- the marts from the states ------------------------------------------------


def city_year_counts(openings: DataFrame) -> DataFrame:
    money = F.when(F.col("n_positive") > 0, F.col("capital_positive")).cast("decimal(30,2)")
    return openings.select("year", "city_code", "state", "n", "n_positive", money.alias("capital_positive"))


def sector_treemap(sectors: DataFrame, pad: int | None = 7) -> DataFrame:
    return sectors.groupBy(activity_division(F.col("activity_code"), pad).alias("activity_division")).agg(
        F.sum("n").alias("total_companies"), F.sum("capital").cast("decimal(30,2)").alias("total_capital")
    )


def region_kpis(regions: DataFrame) -> DataFrame:
    mean = F.round(F.col("capital_positive").cast("decimal(30,2)") / F.nullif(F.col("n_positive"), F.lit(0)), 2)
    return regions.select(
        F.col("state").alias("region"),
        F.col("n").alias("total_companies"),
        mean.alias("mean_capital"),
        pct(F.col("n_active"), F.col("n"), 1).alias("pct_active"),
    )
