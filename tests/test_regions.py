"""Regional comparison: selection rules, shares, labels, growth, matrix."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import marts, regions


def _company(i, city, activity, capital="100.00", year=2020, status=2):
    return (f"{i:08d}", f"C{i}", None, Decimal(capital), dt.date(year, 1, 1), activity, city, None, status, None)


@pytest.fixture()
def companies(spark):
    rows = []
    i = 0
    # city 3550308 (prefix 35 = SP): 3 x division 47, 2 x 62, 1 x 41
    for act, n in [(4711001, 3), (6201500, 2), (4120400, 1)]:
        for _ in range(n):
            i += 1
            rows.append(_company(i, 3550308, act, year=2020 + i % 3))
    # city 3304557 (prefix 33 = RJ): 2 x 47, 2 x 56
    for act, n in [(4711001, 2), (5611201, 2)]:
        for _ in range(n):
            i += 1
            rows.append(_company(i, 3304557, act, capital="0.00" if i % 2 else "300.00", year=2021))
    return spark.createDataFrame(rows, schemas.GOLD)


@pytest.mark.parametrize("selected", [["35"], ["35", "33", "31", "41", "29"], []])
def test_selection_must_have_two_to_four(companies, selected):
    """The page rule; the operators take any list."""
    with pytest.raises(ValueError):
        regions.check_selection(selected)
    assert regions.region_kpis_selected(companies, selected, "city_prefix2").count() == len({"35", "33"} & set(selected))


def test_region_kpis_with_city_prefix_and_state_labels(companies):
    rows = {r.region: r for r in regions.region_kpis_selected(companies, ["35", "33"], "city_prefix2").collect()}
    assert rows["35"].total_companies == 6 and rows["35"].region_label == "SP"
    assert rows["33"].total_companies == 4 and rows["33"].region_label == "RJ"
    # mean of positive capital only: RJ has two companies with 300 and two with 0
    assert rows["33"].mean_capital == Decimal("300.00")


def test_shares_add_to_100_when_top_n_covers_all_divisions(companies):
    share = regions.sector_share(companies, ["35", "33"], "city_prefix2", top_n=10, pad=7)
    totals = {r.region: r.total for r in share.groupBy("region").agg(F.sum("pct").alias("total")).collect()}
    assert totals == {"35": pytest.approx(100.0), "33": pytest.approx(100.0)}
    labels = {r.division: r.sector for r in share.select("division", "sector").distinct().collect()}
    assert labels["47"] == "Comércio Varejista" and labels["62"] == "TI/Software"


def test_top_n_keeps_the_denominator_of_all_divisions(companies):
    share = regions.sector_share(companies, ["35", "33"], "city_prefix2", top_n=1, pad=7)
    got = {(r.region, r.division): r.pct for r in share.collect()}
    assert got == {("35", "47"): 50.0, ("33", "47"): 50.0}


def test_matrix_fills_missing_with_zero(companies):
    share = regions.sector_share(companies, ["35", "33"], "city_prefix2", top_n=10, pad=7)
    m = {r.sector: r for r in regions.sector_share_matrix(share, ["35", "33"]).collect()}
    assert m["Alimentação"]["35"] == 0.0 and m["Alimentação"]["33"] == 50.0
    assert m["Comércio Varejista"].row_total == 100.0


def test_region_top_city_breaks_ties_by_code(spark):
    rows = [_company(i, city, 4711001) for i, city in enumerate([3550308, 3550308, 3500105, 3500105, 3300100])]
    df = spark.createDataFrame(rows, schemas.GOLD)
    ref_city = spark.createDataFrame([(3500105, "Adamantina"), (3550308, "São Paulo")], "code bigint, description string")
    got = {r.region: (r.total_companies, r.top_city) for r in regions.region_top_city(df, ref_city, "city_prefix2").collect()}
    assert got == {"35": (4, "Adamantina"), "33": (1, None)}
    with_null = df.unionByName(df.limit(1).withColumn("city_code", F.lit(None).cast("bigint")))
    assert {r.region for r in regions.region_top_city(with_null, ref_city, "city_prefix2").collect()} == {"35", "33"}


def test_growth_by_region_from_the_city_mart(spark, companies):
    ref_city = spark.createDataFrame([(3550308, "São Paulo")], "code bigint, description string")
    counts = marts.city_year_counts(companies)
    mart = marts.growth_by_city(counts, ref_city)
    series = regions.growth_by_region(counts, ["35", "33"], "city_prefix2", year_from=2021)
    got = [(r.region, r.year, r.openings) for r in series.collect()]  # in order
    assert got == [("33", 2021, 4), ("35", 2021, 2), ("35", 2022, 2)]
    total = mart.agg(F.sum("total")).collect()[0][0]
    assert total == companies.where(F.col("opened_on") >= "1990-01-01").count()


def test_city_ranking_merges_homonyms_only_when_asked(spark):
    mart = spark.createDataFrame(
        [(2020, 1, "Bom Jesus", None, 5), (2020, 2, "Bom Jesus", None, 4), (2020, 3, "Outra", None, 6)],
        "year int, city_code bigint, city_name string, state string, total bigint",
    )
    by_code = [(r.city_name, r.openings) for r in regions.city_ranking(mart, 3).collect()]
    by_name = [(r.city_name, r.openings) for r in regions.city_ranking(mart, 3, ("city_name",)).collect()]
    assert by_code == [("Outra", 6), ("Bom Jesus", 5), ("Bom Jesus", 4)]
    assert by_name == [("Bom Jesus", 9), ("Outra", 6)]


def test_bar_order_and_display_label(spark):
    kpis = spark.createDataFrame(
        [("35", 1200345, 10.0, "São Paulo"), ("33", 5, None, None), ("31", 7, 3.5, "BH")],
        "region string, total_companies bigint, mean_capital double, top_city string",
    )
    assert [r.region for r in regions.bar_order(kpis).collect()] == ["31", "35"]
    labels = {r.region: r.label for r in regions.region_display_label(kpis).collect()}
    assert labels["35"] == "Grupo 35 — São Paulo (1.200.345)" and labels["33"] == "Grupo 33 — ? (5)"


def test_compare_cities_builds_all_frames(spark, companies):
    ref_city = spark.createDataFrame([(3550308, "São Paulo"), (3304557, "Rio")], "code bigint, description string")
    mart = marts.growth_by_city(marts.city_year_counts(companies), ref_city)
    cmp_ = regions.compare_cities(companies, mart, ref_city, [3550308, 3304557], top_n=10, year_from=2020)
    assert {r.city_name for r in cmp_.kpis.collect()} == {"São Paulo", "Rio"}
    m = {r.sector: r for r in cmp_.matrix.collect()}
    assert m["Comércio Varejista"]["3550308"] == 50.0 and m["Comércio Varejista"]["3304557"] == 50.0
    assert cmp_.growth.agg(F.sum("openings")).collect()[0][0] == 10


def test_growth_top_cities_by_code_or_name(spark):
    mart = spark.createDataFrame(
        [(2020, 1, "Bom Jesus", None, 5), (2021, 2, "Bom Jesus", None, 4), (2020, 3, "Outra", None, 6)],
        "year int, city_code bigint, city_name string, state string, total bigint",
    )
    by_code = {r.city_code for r in regions.growth_top_cities(mart, 1).collect()}
    by_name = {r.city_code for r in regions.growth_top_cities(mart, 1, ("city_name",)).collect()}
    assert by_code == {3} and by_name == {1, 2}


def test_sector_shares_of_uneven_groups(spark):
    counts = {"35": {47: 7, 62: 2, 41: 1}, "33": {47: 1, 56: 2}}
    city = {"35": 3550308, "33": 3304557}
    cells = [(region, d) for region, per in counts.items() for d, n in per.items() for _ in range(n)]
    rows = [_company(i, city[region], d * 100000 + 1) for i, (region, d) in enumerate(cells)]
    df = spark.createDataFrame(rows, schemas.GOLD)
    share = {(r.region, r.division): r.pct for r in regions.sector_share(df, ["35", "33"], "city_prefix2").collect()}
    assert share == {("35", "47"): 70.0, ("35", "62"): 20.0, ("35", "41"): 10.0, ("33", "47"): 33.33, ("33", "56"): 66.67}


def test_a_city_under_two_states_has_one_growth_row(spark):
    """State and city are independent raw fields."""
    rows = [_company(i, 3550, 1)[:7] + (state, 2, None) for i, state in enumerate(["SP", "SP", "RJ"])]
    df = spark.createDataFrame(rows, schemas.GOLD)
    counts = marts.city_year_counts(df)
    ref = spark.createDataFrame([(3550, "Border")], "code bigint, description string")
    assert [(r.city_code, r.total) for r in marts.growth_by_city(counts, ref).collect()] == [(3550, 3)]
    assert [(r.openings) for r in regions.growth_by_city_selected(marts.growth_by_city(counts, ref), [3550]).collect()] == [3]
    assert [(r.region, r.openings) for r in regions.growth_by_region(counts, ["SP", "RJ"]).collect()] == [("RJ", 1), ("SP", 2)]


def test_overall_survival_counts_every_sector(spark):
    mart = spark.createDataFrame([(f"s{i}", 10, 2.0, float(i)) for i in range(30)], "sector string, total long, mean double, median double")
    assert regions.survival_overall(mart).first().closed_total == 300
