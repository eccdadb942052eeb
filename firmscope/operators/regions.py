"""Side-by-side comparison of regions or cities (R1-R9) and the municipality
views of the dashboard (B2, B3, L13, Q9).

A *region* is any column or expression (``marts.region_column``): ``state`` by
default, ``'city_prefix2'`` for the two-digit city-code prefix.  Selected
regions or cities are literal lists of any length (the command line keeps the
2 to 4 of the comparison page), applied before any aggregation so the filter reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.functions.clean import activity_division, label_fallback
from firmscope.operators.aggregates import mean_money
from firmscope.operators.marts import region_column


def distinct(selected: Sequence) -> list:
    """The selected members, each once, in the given order."""
    return list(dict.fromkeys(selected))


def check_selection(selected: Sequence, low: int = 2, high: int = 4) -> list:
    """The rule of the comparison page: between ``low`` and ``high`` distinct members."""
    items = distinct(selected)
    if not low <= len(items) <= high:
        raise ValueError(f"select between {low} and {high} regions, got {len(items)}")
    return items


def _map_label(c: Column, mapping: dict[str, str], prefix: str = "") -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], F.concat(F.lit(prefix), c) if prefix else c)


def state_label(region: Column) -> Column:
    """Abbreviation for a two-digit prefix, else the region itself."""
    return _map_label(region, schemas.STATE_PREFIX_LABELS)


def division_label(division: Column) -> Column:
    """Short sector label for a division, else ``'Divisão ' || division``."""
    return _map_label(division, schemas.DIVISION_LABELS, "Divisão ")


def region_top_city(
    companies: DataFrame, ref_city: DataFrame, region: str | Column = "state"
) -> DataFrame:
    """Every region with its company count and its most common city.

    Ties between cities are broken by the smaller city code; rows without a
    region are left out (the list offers regions to pick).  The window runs
    on (region, city) counts, so one partition holds at most the cities of one
    region.
    """
    reg = region_column(region)
    counts = (
        companies.where(reg.isNotNull())
        .groupBy(reg.alias("region"), "city_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("region").orderBy(F.col("n").desc(), F.col("city_code").asc_nulls_last())
    ranked = counts.select(
        "region",
        "city_code",
        "n",
        F.row_number().over(w).alias("_rank"),
        F.sum("n").over(Window.partitionBy("region")).alias("total_companies"),
    ).where(F.col("_rank") == 1)
    return ranked.join(ref_city, ranked.city_code == ref_city.code, "left").select(
        "region", "total_companies", F.col("description").alias("top_city")
    )


def top_cities(companies: DataFrame, ref_city: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` cities with most companies, with names (R2)."""
    counts = companies.groupBy("city_code").agg(F.count(F.lit(1)).alias("total_companies"))
    named = counts.join(ref_city, counts.city_code == ref_city.code, "left").select(
        "city_code",
        label_fallback(F.col("description"), F.col("city_code")).alias("city_name"),
        "total_companies",
    )
    return named.orderBy(
        F.col("total_companies").desc(), F.col("city_code").asc_nulls_last(), F.col("city_name")
    ).limit(n)


def region_kpis_selected(
    companies: DataFrame, selected: Sequence[str], region: str | Column = "state"
) -> DataFrame:
    """Companies and mean positive capital of the selected regions."""
    sel = distinct(selected)
    reg = region_column(region)
    positive = F.when(F.col("share_capital") > 0, F.col("share_capital"))
    return (
        companies.where(reg.isin(sel))
        .groupBy(reg.alias("region"))
        .agg(F.count(F.lit(1)).alias("total_companies"), mean_money(positive).alias("mean_capital"))
        .withColumn("region_label", state_label(F.col("region")))
    )


def city_kpis_selected(
    companies: DataFrame, ref_city: DataFrame, cities: Sequence[int]
) -> DataFrame:
    """Companies and mean positive capital of the selected cities."""
    sel = distinct(cities)
    positive = F.when(F.col("share_capital") > 0, F.col("share_capital"))
    counts = (
        companies.where(F.col("city_code").isin(sel))
        .groupBy("city_code")
        .agg(F.count(F.lit(1)).alias("total_companies"), F.sum(positive).alias("_sum"), F.count(positive).alias("_n"))
    )
    return counts.join(ref_city, counts.city_code == ref_city.code, "left").select(
        "city_code",
        label_fallback(F.col("description"), F.col("city_code")).alias("city_name"),
        "total_companies",
        F.round(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), 2).alias("mean_capital"),
    )


def _sector_share(base: DataFrame, keys: list[str], top_n: int, pad: int | None) -> DataFrame:
    """Shares of the ``top_n`` divisions (over all selected groups) within each group.

    The denominator is every division of the group, so shares of the top
    divisions need not add to 100.
    """
    counts = (
        base.where(F.col("activity_code").isNotNull())
        .groupBy(*keys, activity_division(F.col("activity_code"), pad).alias("division"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = (
        counts.groupBy("division")
        .agg(F.sum("n").alias("_all"))
        .orderBy(F.col("_all").desc(), F.col("division"))
        .limit(top_n)
        .select("division")
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    with_total = counts.select(*keys, "division", "n", total.alias("_total"))
    kept = with_total.join(top, "division", "left_semi")
    return kept.select(
        *keys,
        "division",
        F.round(F.col("n").cast("decimal(20,0)") * 100 / F.col("_total").cast("decimal(20,0)"), 2)
        .cast("double")
        .alias("pct"),
        division_label(F.col("division")).alias("sector"),
    )


def sector_share(
    companies: DataFrame,
    selected: Sequence[str],
    region: str | Column = "state",
    top_n: int = 8,
    pad: int | None = 7,
) -> DataFrame:
    """Percentage of each top division within each selected region."""
    sel = distinct(selected)
    reg = region_column(region)
    base = companies.where(reg.isin(sel)).select(reg.alias("region"), "activity_code")
    out = _sector_share(base, ["region"], top_n, pad)
    return out.withColumn("region_label", state_label(F.col("region")))


def sector_share_city(
    companies: DataFrame,
    ref_city: DataFrame,
    cities: Sequence[int],
    top_n: int = 8,
    pad: int | None = 7,
) -> DataFrame:
    """Percentage of each top division within each selected city."""
    sel = distinct(cities)
    base = companies.where(F.col("city_code").isin(sel)).select("city_code", "activity_code")
    out = _sector_share(base, ["city_code"], top_n, pad)
    return out.join(ref_city, out.city_code == ref_city.code, "left").select(
        "city_code",
        label_fallback(F.col("description"), F.col("city_code")).alias("city_name"),
        "division",
        "pct",
        "sector",
    )


def sector_share_matrix(share: DataFrame, groups: Sequence[str], group_col: str = "region") -> DataFrame:
    """Heat-map matrix: one row per sector, one column per group, summed
    percentage, 0 where absent, plus the row total used for ordering (R9).

    The pivot values are the known selection, so Spark needs no extra pass to
    discover them.
    """
    wide = share.groupBy("sector").pivot(group_col, list(groups)).agg(F.sum("pct")).na.fill(0.0)
    total = sum((F.col(f"`{g}`") for g in groups), F.lit(0.0))
    return wide.withColumn("row_total", F.round(total, 2))


def growth_by_region(
    counts: DataFrame,
    selected: Sequence[str],
    region: str | Column = "state",
    year_from: int = 2000,
) -> DataFrame:
    """Yearly openings of the selected regions in order of region and year, from ``city_year_counts``."""
    sel = distinct(selected)
    reg = region_column(region)
    return (
        counts.where(reg.isin(sel) & (F.col("year") >= year_from))
        .groupBy(reg.alias("region"), "year")
        .agg(F.sum("n").alias("openings"))
        .withColumn("region_label", state_label(F.col("region")))
        .orderBy("region", "year")
    )


def growth_by_city_selected(
    growth_mart: DataFrame, cities: Sequence[int], year_from: int = 2000
) -> DataFrame:
    """Yearly openings of the selected cities in order of city and year, from the mart."""
    sel = distinct(cities)
    return growth_mart.where(F.col("city_code").isin(sel) & (F.col("year") >= year_from)).select(
        "city_code", "city_name", "year", F.col("total").alias("openings")
    ).orderBy("city_code", "year")


def city_ranking(
    growth_mart: DataFrame, n: int = 30, keys: Sequence[str] = ("city_code", "city_name")
) -> DataFrame:
    """Cities with most openings since the mart's first year (B2).  ``keys=('city_name',)``
    merges homonymous cities as a ranking by name does."""
    keys = list(keys)
    return (
        growth_mart.groupBy(*keys)
        .agg(F.sum("total").alias("openings"))
        .orderBy(F.col("openings").desc(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(n)
    )


def growth_top_cities(
    growth_mart: DataFrame, n: int = 5, keys: Sequence[str] = ("city_code",)
) -> DataFrame:
    """Yearly series of the ``n`` cities with most openings (B3, default view).

    ``keys=('city_name',)`` ranks by name, so homonymous cities are summed and
    all of their series are kept, as a selection by name does.
    """
    keys = list(keys)
    top = city_ranking(growth_mart, n, keys).select(*keys)  # n rows by construction
    return growth_mart.join(top, keys, "left_semi").select(
        "year", "city_code", "city_name", "total"
    )


def bubbles_top_years(bubbles_mart: DataFrame, n_years: int = 10) -> DataFrame:
    """Bubble rows restricted to the ``n_years`` years with most companies (Q9).

    The top-years list is a ``LIMIT`` sub-query joined as a left semi-join.
    """
    years = (
        bubbles_mart.groupBy("year")
        .agg(F.sum("total_companies").alias("_n"))
        .orderBy(F.col("_n").desc(), F.col("year"))
        .limit(n_years)
        .select("year")
    )
    return bubbles_mart.join(years, "year", "left_semi").select(
        "year", "city_code", "city_name", "total_companies", "mean_capital"
    )


def bubbles_default_cities(bubbles: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` city names in alphabetical order, and only their rows."""
    names = bubbles.select("city_name").distinct().orderBy("city_name").limit(n)
    return bubbles.join(names, "city_name", "left_semi")


def count_by_city(companies: DataFrame) -> DataFrame:
    """Companies per city code, city known (Q8, the choropleth input)."""
    return (
        companies.where(F.col("city_code").isNotNull())
        .groupBy("city_code")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def survival_top_sectors(survival_mart: DataFrame, n: int = 20) -> DataFrame:
    """Sectors with the longest median survival (Q5 / L4)."""
    return survival_mart.orderBy(
        F.col("median").desc_nulls_last(), F.col("sector").asc_nulls_last()
    ).limit(n)


def survival_overall(survival_mart: DataFrame) -> DataFrame:
    """Headline over every sector of the mart: closed companies and the
    count-weighted mean of the sector means and medians (B4 / A19)."""
    w = F.col("total")
    return survival_mart.agg(
        F.sum(w).alias("closed_total"),
        F.round((F.sum(F.col("mean") * w) / F.sum(w)).cast("decimal(38,10)"), 1).cast("double").alias("weighted_mean"),
        F.round((F.sum(F.col("median") * w) / F.sum(w)).cast("decimal(38,10)"), 1).cast("double").alias("weighted_median"),
    )


def bar_order(kpis: DataFrame, value: str = "mean_capital", label: str = "region") -> DataFrame:
    """Rows for a horizontal bar chart: missing values dropped, ascending."""
    return kpis.where(F.col(value).isNotNull()).orderBy(F.col(value).asc(), F.col(label).asc_nulls_last())


def region_display_label(region_top: DataFrame, group: str = "Grupo ") -> DataFrame:
    """Option label ``Grupo region — most common city (total)`` with ``.`` thousands."""
    total = F.translate(F.format_number(F.col("total_companies"), 0), ",", ".")
    return region_top.withColumn(
        "label",
        F.concat(
            F.lit(group), F.col("region"), F.lit(" — "), F.coalesce(F.col("top_city"), F.lit("?")),
            F.lit(" ("), total, F.lit(")"),
        ),
    )


class Comparison:
    """The four frames of a side-by-side comparison."""

    def __init__(self, kpis: DataFrame, sectors: DataFrame, growth: DataFrame, matrix: DataFrame):
        self.kpis, self.sectors, self.growth, self.matrix = kpis, sectors, growth, matrix


def compare_regions(
    companies: DataFrame,
    counts: DataFrame,
    selected: Sequence[str],
    region: str | Column = "state",
    top_n: int = 8,
    year_from: int = 2000,
    pad: int | None = 7,
) -> Comparison:
    """KPIs, sector shares, yearly openings and the share matrix of the selected regions.

    All frames start from the same selection, so the region filter reaches
    every scan; nothing is cached or collected here.
    """
    sel = distinct(selected)
    kpis = region_kpis_selected(companies, sel, region)
    sectors = sector_share(companies, sel, region, top_n, pad)
    growth = growth_by_region(counts, sel, region, year_from)
    return Comparison(kpis, sectors, growth, sector_share_matrix(sectors, sel, "region"))


def compare_cities(
    companies: DataFrame,
    growth_mart: DataFrame,
    ref_city: DataFrame,
    cities: Sequence[int],
    top_n: int = 8,
    year_from: int = 2000,
    pad: int | None = 7,
) -> Comparison:
    """The same comparison for cities."""
    sel = distinct(cities)
    kpis = city_kpis_selected(companies, ref_city, sel)
    sectors = sector_share_city(companies, ref_city, sel, top_n, pad)
    growth = growth_by_city_selected(growth_mart, sel, year_from)
    matrix = sector_share_matrix(sectors.withColumn("city_code", F.col("city_code").cast("string")),
                                 [str(c) for c in sel], "city_code")
    return Comparison(kpis, sectors, growth, matrix)
