"""Listing over five made-up companies, and saved segments."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from firmscope import schemas
from firmscope.operators import listing

ROWS = [
    ("00000011", "Oak", "900.50", dt.date(2003, 2, 7), 100, 7, "AA"),
    ("00000012", "Elm", "40.25", dt.date(2001, 9, 1), 200, 7, "AA"),
    ("00000013", "Fir", "60.00", dt.date(2009, 1, 1), 200, 8, "BB"),
    ("00000014", "Ash", "0.00", dt.date(2002, 5, 5), 100, 7, "AA"),
    ("00000015", "Yew", "70.75", dt.date(2004, 4, 4), None, 8, "BB"),
]


@pytest.fixture()
def data(spark):
    companies = spark.createDataFrame(
        [(k, n, None, Decimal(c), d, a, ci, s, 2, None) for k, n, c, d, a, ci, s in ROWS],
        schemas.GOLD,
    )
    ref_activity = spark.createDataFrame([(100, "Bakery"), (200, "Mill")], "code bigint, description string")
    ref_city = spark.createDataFrame([(7, "Northtown"), (8, "Southport")], "code bigint, description string")
    return companies, ref_activity, ref_city


def names(df):
    return sorted(r.legal_name for r in df.collect())


def test_no_filter_excludes_zero_capital(data):
    assert names(listing.companies_filtered(*data)) == ["Elm", "Fir", "Oak", "Yew"]


def test_wildcard_words_mean_no_filter(data):
    assert names(listing.companies_filtered(*data, sector="Todos", city="Todas")) == ["Elm", "Fir", "Oak", "Yew"]


@pytest.mark.parametrize(
    "sector,city,expected",
    [
        ("Bakery", None, ["Oak"]),
        (None, "Southport", ["Fir", "Yew"]),
        ("Mill", "Northtown", ["Elm"]),
        ("Bakery", "Southport", []),
        ("' OR '1'='1", None, []),
    ],
)
def test_filters(data, sector, city, expected):
    assert names(listing.companies_filtered(*data, sector=sector, city=city)) == expected
    assert names(listing.companies_preview(*data, 10, sector, city)) == expected


def test_listing_columns(data):
    assert listing.companies_filtered(*data).columns == listing.LISTING_COLUMNS
    assert listing.companies_preview(*data).columns == listing.LISTING_COLUMNS


def test_top_companies_order_and_limit(data):
    companies, ref_activity, _ = data
    rows = listing.top_companies(companies, ref_activity, 2).collect()
    assert [(r.legal_name, r.sector) for r in rows] == [("Oak", "Bakery"), ("Yew", None)]


def test_headline_kpis_use_the_whole_filtered_set(data):
    r = listing.headline_kpis(listing.companies_filtered(*data)).collect()[0]
    assert (r.companies, r.total_capital, r.mean_capital) == (4, Decimal("1071.50"), Decimal("267.88"))


@pytest.mark.parametrize("limit,expected", [(1, ["Elm"]), (2, ["Elm", "Oak"]), (3, ["Elm", "Oak", "Yew"]), (4, ["Elm", "Oak", "Yew", "Fir"]), (9, ["Elm", "Oak", "Yew", "Fir"])])
def test_preview_is_bounded_and_ordered(data, limit, expected):
    assert [r.legal_name for r in listing.companies_preview(*data, limit).orderBy(listing.F.col("opened_on").asc_nulls_last()).collect()] == expected


def test_preview_runs_no_job_when_it_is_built(spark, data):
    tracker, group = spark.sparkContext.statusTracker(), "preview-build"
    spark.sparkContext.setJobGroup(group, "build only")
    listing.companies_preview(*data, 2)
    assert not tracker.getJobIdsForGroup(group)


def test_segment_kpis_all_wildcard_patterns_and_repeated_names(spark, data):
    favourites = json.dumps(
        [
            {"nome": "Tudo", "setor": "Todos", "cidade": "Todas"},
            {"nome": "same", "setor": "Bakery", "cidade": "Todas"},
            {"nome": "same", "setor": "Todos", "cidade": "Northtown"},
            {"nome": "both", "setor": "Mill", "cidade": "Southport"},
            {"nome": "none", "setor": "Forge", "cidade": "Todas"},
        ]
    )
    segs = listing.segments_from_json(spark, favourites)
    got = {r.position: (r.segment, r.companies, r.total_capital) for r in listing.segment_kpis(*data, segs).collect()}
    assert got == {
        0: ("Tudo", 4, Decimal("1071.50")),
        1: ("same", 1, Decimal("900.50")),
        2: ("same", 2, Decimal("940.75")),
        3: ("both", 1, Decimal("60.00")),
        4: ("none", 0, None),
    }


def test_segments_of_users_stay_apart(spark, data):
    one = '[{"nome": "fav", "setor": "Bakery", "cidade": "Todas"}]'
    users = spark.createDataFrame([("a@x", one), ("b@x", one), ("c@x", "[]")], "email string, favourites string")
    segs = listing.segments_from_json(spark, users, owner="email")
    got = sorted((r.owner, r.position, r.companies, r.total_capital) for r in listing.segment_kpis(*data, segs).collect())
    assert got == [("a@x", 0, 1, Decimal("900.50")), ("b@x", 0, 1, Decimal("900.50"))]


def test_filter_options_accent_aware_order(spark):
    ref = spark.createDataFrame(
        [(1, "Zebra"), (2, "Ébano"), (3, "abacate"), (4, "Água"), (5, "Zebra")], "code bigint, description string"
    )
    empty = spark.createDataFrame([], "code bigint, description string")
    rows = listing.sorted_options(listing.filter_options(ref, empty)).collect()
    assert [r.description for r in rows] == ["abacate", "Água", "Ébano", "Zebra"]


@pytest.mark.parametrize(
    "sector,city,expected",
    [
        (None, None, ["Elm", "Fir", "Oak", "Yew"]),
        ("Mill", "Northtown", ["Elm"]),
        ("' OR '1'='1", None, []),
    ],
)
def test_parametrised_sql_listing(spark, data, sector, city, expected):
    df = listing.companies_filtered_sql(spark, *data, sector=sector, city=city)
    assert names(df) == expected


def test_parametrised_sql_limit(spark, data):
    df = listing.companies_filtered_sql(spark, *data, limit=2)
    assert [r.company_id for r in df.collect()] == ["00000012", "00000011"]
