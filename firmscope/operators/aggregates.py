"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmscope.functions.clean import DAYS_PER_YEAR, round_half_up


def mean_money(c: Column, digits: int = 2) -> Column:
    """Exact mean of a decimal column, rounded half-up.

    ``sum / count`` in decimal arithmetic keeps ten fractional digits before
    the final rounding (``avg`` would round to six first).  Null when there are
    no values.
    """
    return F.round(F.sum(c) / F.nullif(F.count(c), F.lit(0)), digits)


def years_mean(days: Column, digits: int, weight: Column | None = None) -> Column:
    """Mean of whole days converted to years and rounded."""
    if weight is None:
        return round_half_up(F.avg(days) / F.lit(DAYS_PER_YEAR), digits)
    return round_half_up(F.sum(days * weight) / F.sum(weight) / F.lit(DAYS_PER_YEAR), digits)


def to_years(c: Column, digits: int) -> Column:
    return round_half_up(c / F.lit(DAYS_PER_YEAR), digits)
