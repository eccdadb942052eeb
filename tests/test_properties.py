"""Property-based checks of the ingest cutter and the column functions."""

import csv
import datetime as dt
import io
import os
import tempfile
import zipfile
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from firmscope.functions import clean
from firmscope.sources.zipshards import expand_member

field_text = st.text(alphabet=list('ab;"\n\x00 çã1'), max_size=12)
records = st.lists(st.lists(field_text, min_size=2, max_size=2), min_size=1, max_size=60)


def _encode(rows):
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", quotechar='"', doublequote=True, quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerows(rows)
    return out.getvalue().encode("latin-1")


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(rows=records, part_bytes=st.integers(min_value=1, max_value=64))
def test_parts_end_at_record_boundaries(rows, part_bytes):
    work = tempfile.mkdtemp(prefix="firmscope-prop-", dir="/tmp")
    archive = os.path.join(work, "Empresas0.zip")
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("E.CSV", _encode(rows))
    manifest = expand_member(archive, "E.CSV", os.path.join(work, "out"), part_bytes)
    parsed, nul = [], 0
    for _, _, folder, index, _, removed in sorted(manifest, key=lambda r: r[3]):
        nul += removed
        with open(f"{folder}/Empresas0-{index:05d}.csv", "rb") as f:
            text = f.read().decode("latin-1")
        parsed += list(csv.reader(io.StringIO(text, newline=""), delimiter=";", quotechar='"'))
    want = [[c.replace("\x00", "") for c in r] for r in rows]
    assert parsed == want
    assert nul == sum(c.count("\x00") for r in rows for c in r)


digits8 = st.text(alphabet="0123456789", min_size=8, max_size=8)
raw_dates = st.one_of(digits8, st.sampled_from(["0", "", "00000000", "20100115\n", "2010-01-15"]), st.none())


def _py_parse(v):
    if v is None or v == "0" or len(v) != 8 or not v.isdigit():
        return None
    try:
        return dt.date(int(v[:4]), int(v[4:6]), int(v[6:]))
    except ValueError:
        return None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(raw_dates, min_size=1, max_size=80))
def test_compact_dates_and_quarantine_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(
        "v",
        clean.parse_compact_date("v").alias("d"),
        clean.opening_date_ok("v", "2026-02-28").alias("ok"),
    ).collect()
    for r in rows:
        want = _py_parse(r.v)
        if want is not None and want.year == 0:
            want = None
        assert r.d == want, r.v
        assert r.ok == (want is not None and dt.date(1900, 1, 1) <= want <= dt.date(2026, 2, 28)), r.v


money = st.decimals(min_value=Decimal("-2000000"), max_value=Decimal("2000000"), places=2, allow_nan=False)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(money, min_size=1, max_size=60))
def test_bands_and_rounding_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(20,2)")
    rows = df.select(
        "v",
        clean.capital_band_index("v").alias("band"),
        clean.round_half_up("v", 1).alias("r1"),
        clean.format_money_br("v").alias("txt"),
    ).collect()
    for r in rows:
        v = r.v
        band = None
        if 0 < v <= 10_000:
            band = 1
        elif 10_000 < v <= 100_000:
            band = 2
        elif 100_000 < v <= 1_000_000:
            band = 3
        elif v > 1_000_000:
            band = 4
        assert r.band == band
        assert r.r1 == float(v.quantize(Decimal("0.1"), ROUND_HALF_UP))
        assert r.txt == f"{v:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=99_999_999)), min_size=1, max_size=60))
def test_activity_division_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = df.select("v", clean.activity_division("v", 7).alias("p"), clean.activity_division("v", None).alias("n")).collect()
    for r in rows:
        if r.v is None:
            assert r.p is None and r.n is None
        else:
            assert r.p == str(r.v).rjust(7, "0")[:7][:2]
            assert r.n == str(r.v)[:2]
