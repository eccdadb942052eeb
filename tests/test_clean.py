"""Cleaning rules on hand-made values (FIXTURES.md section 2.3)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from firmscope.functions import clean

AS_OF = "2026-02-28"


def _one_col(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_normalise_key_pads_and_truncates(spark):
    df = _one_col(spark, ["1", "00000001", "123456789"])
    got = [r[0] for r in df.select(clean.normalise_key("v")).collect()]
    assert got == ["00000001", "00000001", "12345678"]


def test_parse_code(spark):
    df = _one_col(spark, ["", None, "6201", "x"])
    got = [r[0] for r in df.select(clean.parse_code("v")).collect()]
    assert got == [None, None, 6201, None]


def test_parse_decimal_comma_and_unparsable_count(spark):
    df = _one_col(spark, ["1000,50", None, "", "abc"])
    rows = df.select(clean.parse_decimal_comma("v").alias("c"), clean.capital_unparsable("v").alias("u")).collect()
    assert [r.c for r in rows] == [Decimal("1000.50"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00")]
    assert [r.u for r in rows] == [False, False, True, True]


def test_opening_date_quarantine_with_reasons(spark):
    values = ["20100115", "0", "00000000", "20210231", "18991231", "20990101", None, "20100115\n"]
    df = _one_col(spark, values)
    rows = df.select(
        clean.opening_date_ok("v", AS_OF).alias("ok"),
        clean.quarantine_reason("v", AS_OF).alias("reason"),
    ).collect()
    assert [r.ok for r in rows] == [True, False, False, False, False, False, False, False]
    assert [r.reason for r in rows] == [
        None,
        "malformed",
        "impossible_date",
        "impossible_date",
        "before_floor",
        "after_as_of",
        "missing",
        "malformed",
    ]


def test_status_date(spark):
    df = _one_col(spark, ["20200101", "0", "00000000", ""])
    got = [r[0] for r in df.select(clean.parse_compact_date("v")).collect()]
    assert got == [dt.date(2020, 1, 1), None, None, None]


def test_activity_division_padding(spark):
    df = spark.createDataFrame([(111301,), (4711001,)], "code bigint")
    padded = [r[0] for r in df.select(clean.activity_division("code", 7)).collect()]
    raw = [r[0] for r in df.select(clean.activity_division("code", None)).collect()]
    assert padded == ["01", "47"]
    assert raw == ["11", "47"]


def test_scrub_nul(spark):
    df = _one_col(spark, ["B\x00C", "plain", None])
    rows = df.select(clean.scrub_chars("v").alias("s"), clean.scrubbed_count("v").alias("n")).collect()
    assert [(r.s, r.n) for r in rows] == [("BC", 1), ("plain", 0), (None, None)]


def test_capital_bands_are_right_closed(spark):
    df = spark.createDataFrame(
        [(Decimal(x),) for x in ["10000", "10000.01", "100000", "1000000", "1000000.01", "0", "-5"]],
        "v decimal(20,2)",
    )
    got = [r[0] for r in df.select(clean.capital_band_index("v")).collect()]
    assert got == [1, 2, 2, 3, 4, None, None]


def test_round_half_up_matches_numeric_rounding(spark):
    df = spark.createDataFrame([(2.675,), (2.5,), (-2.5,), (0.125,)], "v double")
    got = [r[0] for r in df.select(clean.round_half_up("v", 2)).collect()]
    assert got == [2.68, 2.5, -2.5, 0.13]
    got0 = [r[0] for r in df.select(clean.round_half_up("v", 0)).collect()]
    assert got0 == [3.0, 3.0, -3.0, 0.0]


def test_format_money_br(spark):
    df = spark.createDataFrame([(Decimal("1234567.5"),), (Decimal("-1234.56"),)], "v decimal(20,2)")
    got = [r[0] for r in df.select(clean.format_money_br("v")).collect()]
    assert got == ["1.234.567,50", "-1.234,56"]


def test_label_fallback_and_null_code(spark):
    df = spark.createDataFrame([("Varejo", 4711), (None, 6201), (None, None)], "d string, c bigint")
    got = [r[0] for r in df.select(clean.label_fallback("d", "c", "CNAE ")).collect()]
    assert got == ["Varejo", "CNAE 6201", None]


def test_severity_badge(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (4.99,), (5.0,)], "p double")
    got = [r[0] for r in df.select(clean.severity_badge("p")).collect()]
    assert got == ["OK", "Atenção", "Atenção", "Crítico"]


def test_pct_null_safe_denominator(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (1, 8)], "n long, d long")
    got = [r[0] for r in df.select(clean.pct(F.col("n"), F.col("d"), 1)).collect()]
    assert got == [33.3, None, 12.5]


def test_capital_band_labels(spark):
    df = spark.createDataFrame([(Decimal("5"),), (Decimal("50000"),), (Decimal("2000000"),), (Decimal("0"),)], "v decimal(20,2)")
    got = [r[0] for r in df.select(clean.capital_band("v")).collect()]
    assert got == ["Até 10k", "10k - 100k", "Acima de 1M", None]
