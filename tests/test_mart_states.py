"""Mart states changed by difference equal those built anew; published together with the version they describe."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import mart_states, marts
from firmscope.plans import pipeline, store

BASE = dt.date(1999, 1, 1)


def _company(rng, key):
    opened = BASE + dt.timedelta(days=rng.randrange(900))
    closed = rng.choice([None, BASE + dt.timedelta(days=rng.randrange(3000))])
    capital = rng.choice([Decimal("0.00"), Decimal("-3.00"), Decimal(rng.randrange(10**6)).scaleb(-2)])
    return (
        key, f"C{key}", None, capital, opened, rng.choice([None, 111, 222, 3]), rng.choice([None, 1, 2]),
        rng.choice([None, "SP", "RJ"]), rng.choice([2, 8, 8, None]), closed,
    )


def _versions(seed):
    rng = random.Random(seed)
    old = [_company(rng, f"{k:08d}") for k in range(200)]
    new = [_company(rng, r[0]) if rng.random() < 0.2 else r for r in old if rng.random() > 0.1]
    new += [_company(rng, f"{k:08d}") for k in range(500, 530)]
    new += new[:3]  # repeated rows
    new += [("00000900", None, None, Decimal("0.00"), BASE, None, None, None, None, None)]
    return old + old[-2:], new


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(mart_states.STATES))
def test_a_changed_state_equals_the_one_built_anew(spark, name):
    old, new = (spark.createDataFrame(r, schemas.GOLD) for r in _versions(5))
    change = mart_states.state_of(name, mart_states.difference(old, new))
    got = mart_states.updated(name, mart_states.state_of(name, mart_states.whole(old)), change)
    want = mart_states.state_of(name, mart_states.whole(new))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert _rows(got) == _rows(want)
    back = mart_states.updated(name, got, mart_states.state_of(name, mart_states.difference(new, old)))
    assert _rows(back) == _rows(mart_states.state_of(name, mart_states.whole(old)))
    assert mart_states.difference(new, new).count() == 0


@pytest.mark.parametrize("name", sorted(mart_states.STATES))
def test_a_state_compares_its_own_columns_alone(spark, name):
    old, new = (spark.createDataFrame(r, schemas.GOLD) for r in _versions(9))
    own = mart_states.difference(old, new, name)
    assert own.columns == [*mart_states.STATES[name][1], mart_states.WEIGHT] and "company_id" not in own.columns
    got = mart_states.updated(name, mart_states.state_of(name, mart_states.whole(old)), mart_states.state_of(name, own))
    assert _rows(got) == _rows(mart_states.state_of(name, mart_states.whole(new)))
    # Companies that changed in nothing the state depends on are no difference, however many there are.
    renamed = old.withColumn("company_id", F.concat(F.lit("x"), "company_id"))
    assert mart_states.difference(old, renamed, name).count() == 0 < mart_states.difference(old, renamed).count()


def test_a_state_never_goes_below_zero(spark):
    old, new = (spark.createDataFrame(r, schemas.GOLD) for r in _versions(6))
    change = mart_states.state_of("regions", mart_states.difference(old, new.limit(0)))
    with pytest.raises(Exception, match="takes away"):
        mart_states.updated("regions", mart_states.state_of("regions", mart_states.whole(new.limit(0))), change).collect()


def test_marts_of_states_equal_the_rebuilt_ones(spark, tmp_dir):
    lk = pipeline.Lookups(
        spark.createDataFrame([(111, "Bakery"), (222, "Mill")], "code bigint, description string"),
        spark.createDataFrame([(1, "Northtown")], "code bigint, description string"),
    )
    for rows in (*_versions(7), *_versions(8)):
        version = store.new_version_path(spark, f"{tmp_dir}/gold")
        spark.createDataFrame(rows, schemas.GOLD).write.parquet(version)
        store.publish(spark, f"{tmp_dir}/gold", version)
        done = pipeline.maintain_marts(spark, tmp_dir, lk, survival_min_count=1)
        assert all(ok for _, ok, _ in done), done
        described, _ = pipeline.current_states(spark, tmp_dir)
        assert described == version
        gold = pipeline.read_gold(spark, tmp_dir)
        pipeline.rebuild_marts(spark, gold, lk, f"{tmp_dir}/anew", pipeline.default_marts(1))
        for name, _, _ in done:
            got, want = pipeline.read_mart(spark, tmp_dir, name), pipeline.read_mart(spark, f"{tmp_dir}/anew", name)
            assert got.columns == want.columns and _rows(got) == _rows(want), name
    # A second call for the same Gold changes no state.
    before = store.current(spark, f"{tmp_dir}/mart_states")
    pipeline.maintain_marts(spark, tmp_dir, lk, survival_min_count=1)
    assert store.current(spark, f"{tmp_dir}/mart_states") == before


def test_kpis_of_a_state_without_positive_capital(spark):
    rows = [("00000001", None, None, Decimal("0.00"), BASE, 111, 1, "SP", 2, None)]
    gold = spark.createDataFrame(rows, schemas.GOLD)
    got = mart_states.region_kpis(mart_states.state_of("regions", mart_states.whole(gold)))
    assert _rows(got) == _rows(marts.region_kpis(gold))
