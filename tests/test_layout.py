"""The curve layout: what look-ups read, counted by the scan's own metric."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import layout

ROWS = 120_000


@pytest.fixture(scope="module")
def gold(spark):
    k = F.col("id")
    columns = {
        "company_id": F.lpad(F.pmod(F.xxhash64(k), F.lit(10**8)).cast("string"), 8, "0"),
        "legal_name": F.concat(F.lit("C"), k.cast("string")),
        "legal_nature_code": F.lit(2062).cast("bigint"),
        "share_capital": (k % 1000).cast("decimal(20,2)"),
        "opened_on": F.date_add(F.lit("1990-01-01"), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(12_000)).cast("int")),
        "activity_code": F.when(k % 50 != 0, F.pmod(F.xxhash64(k, F.lit(2)), F.lit(900))),
        "city_code": F.when(k % 3 == 0, 7).otherwise(F.pmod(F.xxhash64(k, F.lit(3)), F.lit(500))).cast("bigint"),
        "state": F.lit("SP"),
        "status_code": F.lit(2),
        "status_on": F.lit(None).cast("date"),
    }
    df = spark.range(ROWS).select(*[c.cast(schemas.GOLD[n].dataType).alias(n) for n, c in columns.items()])
    return df


@pytest.fixture(scope="module")
def path(spark, gold, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("curve") / "gold")
    before = layout.ROW_GROUP_BYTES
    layout.ROW_GROUP_BYTES = 1 << 17  # small row groups for a small table
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    layout.write_along_curve(gold, folder, companies=3000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    layout.ROW_GROUP_BYTES = before
    return folder


def rows_read(df) -> int:
    """Rows that left the file scans of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(k).metrics().apply("numOutputRows").value()) for k in range(leaves.size()))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_nothing_is_lost_or_changed(spark, gold, path):
    assert same(layout.read_gold_files(spark, path), gold)


def test_a_company_is_found_in_few_row_groups(spark, gold, path):
    key = gold.where("legal_name = 'C77'").first().company_id
    found = layout.look_up(spark, path, company_id=key)
    assert same(found, gold.where(F.col("company_id") == key)) and found.count() >= 1
    assert rows_read(layout.look_up(spark, path, company_id=key)) < ROWS / 4
    assert rows_read(layout.look_up(spark, path, company_id="no such")) < ROWS / 4


@pytest.mark.parametrize("values", [{"city_code": 31}, {"activity_code": 444}, {"opened_on": dt.date(2001, 5, 5)}])
def test_each_column_of_the_curve_prunes(spark, gold, path, values):
    (column, value), = values.items()
    assert same(layout.look_up(spark, path, **values), gold.where(F.col(column) == F.lit(value)))
    assert rows_read(layout.look_up(spark, path, **values)) < 0.6 * ROWS  # a third of the rows are of one city


def test_codes_keep_the_order_and_bits_interleave(spark, gold):
    cuts = layout.rank_cuts(gold)
    assert all(0 < len(v) < 2**layout.BITS for v in cuts.values())
    rows = gold.select(*layout.CURVE_COLUMNS, layout.curve_key(gold, cuts).alias("key")).sample(0.01, 3).collect()
    epoch = dt.date(1970, 1, 1)

    def by_hand(r):
        key = 0
        for place, c in enumerate(layout.CURVE_COLUMNS):
            v = r[c]
            v = (v - epoch).days if isinstance(v, dt.date) else v
            code = 0 if v is None else sum(x <= v for x in cuts[c])
            for bit in range(layout.BITS):
                key |= (code >> bit & 1) << (3 * bit + place)
        return key

    assert all(r.key == by_hand(r) for r in rows)


def test_an_empty_table(spark, gold, tmp_path):
    layout.write_along_curve(gold.limit(0), str(tmp_path / "e"))
    assert layout.look_up(spark, str(tmp_path / "e"), city_code=1).count() == 0
