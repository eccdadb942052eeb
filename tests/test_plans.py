"""Physical-plan guards: no quadratic joins, bounded top-k, predicates at the scan."""

import contextlib
import io

import pytest

from firmscope.plans import catalog
from tests.conftest import SF_SMALL

WRITES_FILES = {"publish_if_valid", "rebuild_marts", "ingest_zip_shards", "scan_delimited", "export_csv", "archive_running_total", "filter_options_sorted", "publish_passing", "load_reference", "build_gold_keyed", "gate_duplicates_keyed", "company_lookup", "city_lookup"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    q = catalog.queries()
    return {k: plan_text(q[k](spark, SF_SMALL)) for k in sorted(q) if k not in WRITES_FILES}


def test_no_cartesian_or_nested_loop_join(plans):
    bad = {k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


@pytest.mark.parametrize("key", ["top_companies", "top_companies_filtered", "top_cities", "survival_top_sectors"])
def test_top_k_is_a_bounded_take_ordered(plans, key):
    assert "TakeOrderedAndProject" in plans[key]


@pytest.mark.parametrize(
    "key,fragment",
    [
        ("state_openings_by_year", "EqualTo(state,NATION_15)"),
        ("region_kpis_selected", "In(state"),
        ("survival_by_sector", "EqualTo(status_code,8)"),
        ("capital_stats", "GreaterThan(share_capital,0.00)"),
    ],
)
def test_filters_reach_the_parquet_scan(plans, key, fragment):
    pushed = [line for line in plans[key].splitlines() if "PushedFilters" in line]
    assert any(fragment in line for line in pushed), pushed


def test_gold_scans_read_only_needed_columns(plans):
    # count by city needs one column of the ten in the Gold table
    schemas = [line for line in plans["count_by_city"].splitlines() if "ReadSchema" in line]
    assert schemas and all(line.strip().endswith("struct<city_code:bigint>") for line in schemas)


def test_gold_layout_rebalances_without_sampling(spark):
    from firmscope.operators.gold import gold_layout
    from firmscope.plans.catalog import Ctx

    plan = plan_text(gold_layout(Ctx(spark, SF_SMALL).built_gold()))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "rangepartitioning" not in plan


def test_raw_tables_kept_by_key_are_joined_and_grouped_without_an_exchange(spark, tmp_dir):
    from firmscope.operators import gates, gold
    from firmscope.plans import pipeline
    from firmscope.plans.catalog import AS_OF, Ctx
    from firmscope.sources import keyed

    c = Ctx(spark, SF_SMALL)
    plain = c.built_gold()
    comp, est = pipeline.write_bronze(c.companies_raw, c.establishments_raw, tmp_dir, buckets=4)
    built = gold.build_gold(comp, est, AS_OF)
    plan = plan_text(built)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan_text(gates.gate_duplicates(built)).count("hashpartitioning") == 0
    assert "hashpartitioning" in plan_text(plain)
    assert sorted(map(str, built.collect())) == sorted(map(str, plain.collect()))
    # Another session knows the table by its folder alone.
    path = pipeline.bronze_paths(spark, tmp_dir)[0]
    other = spark.newSession()
    spark.sql(f"DROP TABLE {keyed._name(path)}")
    again = keyed.read_keyed(other, path)
    assert again.count() == c.companies_raw.count() and again.schema == comp.schema


def test_buckets_of_the_raw_tables_follow_the_inputs_size(spark, monkeypatch):
    from firmscope.plans import catalog_pipeline
    from firmscope.plans.catalog import Ctx
    from firmscope.sources import driver_tables, keyed

    c = Ctx(spark, SF_SMALL)
    size = driver_tables.input_bytes(spark, SF_SMALL, ["lineitem", "orders", "customer", "supplier"])
    monkeypatch.setattr(keyed, "BUCKET_BYTES", size // 21)
    built = catalog_pipeline._keyed_gold(c)
    n = keyed.buckets_for(size)
    assert n > 20 and f"{n} out of {n}" in plan_text(built)
    assert sorted(map(str, built.collect())) == sorted(map(str, c.built_gold().collect()))


def test_joins_of_the_large_tables_have_tasks_for_their_size(spark, monkeypatch):
    from firmscope.sources import driver_tables

    d, part = driver_tables, 2 << 10

    def frames():
        return [f(spark, SF_SMALL) for f in (d.companies_frame, d.establishments_raw, d.companies_raw)]

    before = [sorted(map(str, df.collect())) for df in frames()]
    monkeypatch.setattr(d, "PART_BYTES", part)
    sides = (["lineitem", "orders", "customer"], "l_orderkey"), (["lineitem", "orders"], "l_orderkey"), (["orders", "customer"], "o_custkey")
    for df, (facts, key), rows in zip(frames(), sides, before, strict=True):
        n = -(-d.input_bytes(spark, SF_SMALL, facts) // part)
        dealt = [x for x in plan_text(df).splitlines() if "hashpartitioning" in x and key in x]
        assert n > 8 and dealt and all(f", {n})" in x or f", {n}, " in x for x in dealt), dealt
        assert sorted(map(str, df.collect())) == rows


def test_segments_scan_the_companies_once(spark):
    from firmscope.plans.catalog import Ctx

    c = Ctx(spark, SF_SMALL)
    plan = plan_text(catalog.queries()["segment_kpis"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "share_capital" in line]
    assert len(scans) == 1, scans
    assert c.companies.count() > 0


def test_the_profile_multiplies_no_row_by_its_columns_before_combining(plans):
    assert "Expand" not in plans["describe_schema"]


def test_nothing_imports_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"firmscope\.llm|from \.+llm", p.read_text())]
    assert not users
