"""Timing of the ten dashboard queries over a published warehouse.

Each query is built from the published Gold, lookups and marts and timed
``runs`` times (a ``noop`` write, so nothing is collected).  The plan text is Spark's own formatted plan.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.operators import listing, metrics, regions
from firmscope.plans import pipeline


def dashboard_queries(
    spark: SparkSession, warehouse: str, lookups: pipeline.Lookups, as_of: str
) -> dict[str, tuple[str, Callable[[], DataFrame]]]:
    gold = pipeline.read_gold(spark, warehouse)

    def mart(name):
        return pipeline.read_mart(spark, warehouse, name)

    options = listing.filter_options(lookups.activity, lookups.city)
    return {
        "Q1": ("filter options: sectors", lambda: listing.sorted_options(options.where(F.col("kind") == "sector"))),
        "Q2": ("filter options: cities", lambda: listing.sorted_options(options.where(F.col("kind") == "city"))),
        "Q3": ("listing preview, no filter", lambda: listing.companies_preview(
            gold, lookups.activity, lookups.city, 30_000)),
        "Q4": ("capital ranking, top 25", lambda: listing.top_companies(gold, lookups.activity, 25)),
        "Q5": ("survival mart, top 20", lambda: regions.survival_top_sectors(mart("survival_by_sector"), 20)),
        "Q6": ("growth mart, ordered", lambda: mart("growth_by_city").select("year", "city_code", "total")
               .orderBy("city_code", "year")),
        "Q7": ("data quality, one pass", lambda: metrics.data_quality_report(gold, lookups.activity, as_of)),
        "Q8": ("count by city", lambda: regions.count_by_city(gold).orderBy(F.col("total").desc())),
        "Q9": ("bubbles, ten busiest years", lambda: regions.bubbles_top_years(mart("bubbles_year_city"), 10)
               .orderBy("year", "city_code")),
        "Q10": ("treemap mart, ordered", lambda: mart("sector_treemap").orderBy(F.col("total_companies").desc())),
    }


def time_queries(
    queries: dict[str, tuple[str, Callable[[], DataFrame]]], runs: int = 5, explain: bool = False
) -> list[dict]:
    out = []
    for qid, (name, build) in queries.items():
        times = []
        rows = build().count()
        for _ in range(runs):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append((time.perf_counter() - t0) * 1000)
        entry = {
            "id": qid,
            "name": name,
            "rows": rows,
            "mean_ms": round(statistics.mean(times), 2),
            "min_ms": round(min(times), 2),
            "max_ms": round(max(times), 2),
            "std_ms": round(statistics.stdev(times), 2) if len(times) > 1 else 0.0,
        }
        if explain:
            entry["plan"] = _formatted_plan(build())
        out.append(entry)
    return out


def _formatted_plan(df: DataFrame) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()
