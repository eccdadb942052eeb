"""Ranks and running sums by ranges against sorting on the driver; exact and sketched profiles."""

import random

import pytest
from pyspark.sql import functions as F

from firmscope.operators import profiling, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40), 7, 7, 7, 7]), k, rng.choice([None, k % 5])) for k in range(600)]
    return data, spark.createDataFrame(data, "g string, x int, k int, v int").repartition(6)


def test_dense_ranks_within_groups(rows):
    data, df = rows
    got = {r.k: r.place for r in ranges.dense_ranks(df, [F.col("x").asc_nulls_first()], "place", ["g"]).collect()}
    order = {g: {x: i for i, x in enumerate(sorted({r[1] for r in data if r[0] == g}, key=lambda x: (x is not None, x or 0)), 1)} for g in ("a", "b", None)}
    assert got == {k: order[g][x] for g, x, k, _ in data}


def test_running_sums_over_the_table_and_within_groups(rows):
    data, df = rows
    total, want = 0, {}
    for _, x, k, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total += v or 0
        want[k] = total
    order = [F.col("x").asc_nulls_first(), F.col("k")]
    out = ranges.running_sums(df, order, F.col("v"))
    assert {r.k: r.running_total for r in out.collect()} == want and out.columns == [*df.columns, "running_total"]
    by_group = {r.k: r.running_total for r in ranges.running_sums(df, order, F.col("v"), group=["g"]).collect()}
    assert max(by_group[k] for g, _, k, _ in data if g == "a") == sum(v or 0 for g, _, _, v in data if g == "a")


def test_an_empty_table_has_no_places(rows):
    assert ranges.dense_ranks(rows[1].limit(0), [F.col("x")]).count() == 0


def test_ranges_are_many_tasks(spark, rows):
    cut = ranges.cut_into_ranges(spark.range(200_000), [F.col("id")])
    found = cut.groupBy(ranges.PART).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo and a[ranges.PART] < b[ranges.PART] for a, b in zip(found, found[1:]))


def test_profile_counts_distinct_values_exactly_or_by_sketch(spark):
    data = [(i % 7 or None, float(i % 3), -0.0 if i % 2 else 0.0, f"t{i}", None) for i in range(1000)]
    df = spark.createDataFrame(data, "i int, d double, z double, s string, n string").withColumn("b", F.col("i") > 3)
    exact = {r.column_name: r for r in profiling.profile_columns(df).collect()}
    assert {k: r.distinct_values for k, r in exact.items()} == {"i": 6, "d": 3, "z": 1, "s": 1000, "n": 0, "b": 2}
    assert exact["i"].nulls == 143 and (exact["i"].smallest, exact["i"].largest) == ("1", "6") and exact["n"].smallest is None
    sketch = {r.column_name: r.distinct_values for r in profiling.profile_columns(df, "sketch").collect()}
    assert sketch["i"] == 6 and sketch["n"] == 0 and abs(sketch["s"] - 1000) < 60
    with pytest.raises(ValueError):
        profiling.profile_columns(df, "guess")
