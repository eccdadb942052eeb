"""Marts on hand-made rows: survival semantics and percentiles against brute force."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import marts, metrics


def _closed(i, code, opened, closed, status=8):
    return (f"{i:08d}", f"C{i}", None, Decimal("1.00"), opened, code, 1, "SP", status, closed)


@pytest.fixture()
def companies(spark):
    rng = np.random.default_rng(7)
    rows = []
    base = dt.date(2000, 1, 1)
    for i in range(300):
        code = [111, 222, 333, None][i % 4]
        life = int(rng.integers(0, 4000))
        rows.append(_closed(i, code, base, base + dt.timedelta(days=life)))
    rows.append(_closed(900, 111, base, base - dt.timedelta(days=5)))  # inverted: dropped
    rows.append(_closed(901, 111, base, None))  # no closing date: dropped
    rows.append(_closed(902, 111, base, base + dt.timedelta(days=10), status=2))  # active: dropped
    return spark.createDataFrame(rows, schemas.GOLD)


def test_codes_sharing_a_description_merge_and_null_code_is_null_sector(spark, companies):
    ref = spark.createDataFrame([(111, "Comércio"), (222, "Comércio")], "code bigint, description string")
    got = {r.sector: r.total for r in marts.survival_by_sector(companies, ref, 1).collect()}
    assert got == {"Comércio": 150, "CNAE 333": 75, None: 75}


def test_percentiles_equal_brute_force(spark, companies):
    ref = spark.createDataFrame([], "code bigint, description string")
    out = {r.sector: r for r in marts.survival_by_sector(companies, ref, 1).collect()}
    for i, code in enumerate([111, 222, 333]):
        days = np.array(
            [(r.status_on - r.opened_on).days for r in companies.collect()
             if r.activity_code == code and r.status_code == 8 and r.status_on and r.status_on >= r.opened_on]
        )
        row = out[f"CNAE {code}"]
        assert row.total == len(days)
        for name, q in [("median", 50), ("p05", 5), ("q1", 25), ("q3", 75), ("p95", 95)]:
            want = float(Decimal(str(np.percentile(days, q) / 365.25)).quantize(Decimal("0.01"), "ROUND_HALF_UP"))
            assert getattr(row, name) == pytest.approx(want, abs=0.011), (code, name)
        assert float(row.mean) == pytest.approx(days.mean() / 365.25, abs=0.006)


def test_min_count_threshold(spark, companies):
    ref = spark.createDataFrame([], "code bigint, description string")
    assert marts.survival_by_sector(companies, ref, 76).count() == 0
    assert marts.survival_by_sector(companies, ref, 75).count() == 4


def test_survival_global_and_discards(spark, companies):
    g = metrics.survival_global(companies).collect()[0]
    assert g.closed == 300
    d = metrics.survival_discards(companies).collect()[0]
    assert (d.no_date, d.inverted_date, d.total_closed) == (1, 1, 302)


def test_treemap_uses_padded_division(spark):
    rows = [(f"{i:08d}", "x", None, Decimal("10.00"), dt.date(2020, 1, 1), code, 1, "SP", 2, None)
            for i, code in enumerate([111301, 4711001, 4711002, None])]
    df = spark.createDataFrame(rows, schemas.GOLD)
    got = {r.activity_division: (r.total_companies, r.total_capital) for r in marts.sector_treemap(df, 7).collect()}
    assert got == {"01": (1, Decimal("10.00")), "47": (2, Decimal("20.00"))}
    legacy = {r.activity_division for r in marts.sector_treemap(df, None).collect()}
    assert legacy == {"11", "47"}


def test_invariants_on_driver_tables(spark):
    """Band counts add up; the growth mart covers every dated company with a city since 1990."""
    from pyspark.sql import functions as F

    from firmscope.operators import profiling
    from firmscope.plans.catalog import BAND_SCALE, Ctx
    from tests.conftest import SF_SMALL

    c = Ctx(spark, SF_SMALL)
    bands = profiling.capital_bands(c.companies, c.ref_legal_nature, BAND_SCALE)
    positive = profiling.capital_with_legal_nature(c.companies, c.ref_legal_nature).count()
    assert bands.agg(F.sum("companies")).collect()[0][0] == positive
    growth = marts.growth_by_city(marts.city_year_counts(c.companies), c.ref_city).agg(F.sum("total")).collect()[0][0]
    since = c.companies.where(F.col("city_code").isNotNull() & (F.col("opened_on") >= "1990-01-01")).count()
    assert growth == since


def test_the_adapter_shows_every_gap(spark):
    """Each guard and limit drops or labels something on the test tables (sf0.01)."""
    from firmscope.plans.catalog import Ctx
    from tests.conftest import SF_ORACLE

    c = Ctx(spark, SF_ORACLE)
    gold = c.companies
    gaps = gold.agg(
        *[F.count_if(F.col(x).isNull()).alias(x) for x in ("opened_on", "activity_code", "city_code", "state", "status_on")],
        F.count_if(F.col("status_on") < F.col("opened_on")).alias("inverted"),
        F.count_if(F.year("opened_on") < 1990).alias("before_1990"),
        F.count_distinct(F.year("opened_on")).alias("years"),
    ).first()
    assert all(gaps[x] > 0 for x in gaps.asDict()) and gaps.years > 10
    assert gold.join(c.ref_city, F.col("city_code") == F.col("code"), "left_anti").where("city_code IS NOT NULL").count() > 0
    assert gold.where("city_code IS NOT NULL").groupBy("city_code").agg(F.count_distinct("state").alias("n")).where("n > 1").count() > 0
    raw = c.companies_raw.agg(F.count_if(F.col("capital_social") == "n/d").alias("bad"), F.count_if(F.col("capital_social").isNull()).alias("none")).first()
    assert raw.bad > 0 and raw.none > 0
