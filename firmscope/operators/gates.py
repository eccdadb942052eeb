"""Quality gates over a freshly built Gold table.

``gate_metrics`` returns one row per gate (name, value, rule, passed); it needs
three passes over the data, each reducing to a handful of rows:

* Gold grouped by opening decade -> rows, null dates, out-of-range dates and
  the largest decade share (G1, G4, G5, G6);
* Gold grouped by key -> duplicate count (G3);
* the raw company file counted -> retention (G2).

``run_gates`` brings only those six rows to the driver and raises when any
gate fails, naming every failure.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from firmscope.functions.clean import DEFAULT_DATE_FLOOR, _date_lit, pct
from firmscope.operators.metrics import decade_of


@dataclass(frozen=True)
class GateRules:
    min_rows: int = 40_000_000
    min_retention_pct: float = 90.0
    max_duplicates: int = 0
    max_null_dates: int = 0
    max_out_of_range: int = 0
    max_decade_pct: float = 60.0


class GateFailure(RuntimeError):
    def __init__(self, failed: list[str], metrics: list[tuple]):
        self.failed = failed
        self.metrics = metrics
        super().__init__("load aborted, failed gates: " + ", ".join(failed))


def _decade_stats(gold: DataFrame, as_of, floor) -> DataFrame:
    d = F.col("opened_on")
    per_decade = gold.groupBy(decade_of(d).alias("decade")).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(d.isNull()).alias("nulls"),
        F.count_if((d < _date_lit(floor)) | (d > _date_lit(as_of))).alias("oor"),
    )
    return per_decade.agg(
        F.sum("c").alias("rows"),
        F.sum("nulls").alias("null_dates"),
        F.sum("oor").alias("out_of_range"),
        pct(F.max("c"), F.sum("c"), 1).alias("decade_pct"),
    )


def gate_volume(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count(F.lit(1)).alias("value"))


def gate_retention(gold: DataFrame, companies_raw: DataFrame) -> DataFrame:
    """Gold rows as a percentage of raw company rows (the raw count is a
    scalar sub-query, not a join)."""
    bronze = companies_raw.agg(F.count(F.lit(1))).scalar()
    return gold.agg(pct(F.count(F.lit(1)), bronze, 2).alias("value"))


def gate_duplicates(gold: DataFrame, key: str = "company_id") -> DataFrame:
    """``count(*) - count(distinct key)``, computed as a keyed aggregation."""
    per_key = gold.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("value"))


def gate_null_dates(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count_if(F.col("opened_on").isNull()).alias("value"))


def gate_date_range(gold: DataFrame, as_of, floor=DEFAULT_DATE_FLOOR) -> DataFrame:
    d = F.col("opened_on")
    return gold.agg(F.count_if((d < _date_lit(floor)) | (d > _date_lit(as_of))).alias("value"))


def gate_decade_concentration(gold: DataFrame) -> DataFrame:
    per_decade = gold.groupBy(decade_of(F.col("opened_on")).alias("decade")).agg(F.count(F.lit(1)).alias("c"))
    return per_decade.agg(pct(F.max("c"), F.sum("c"), 1).alias("value"))


def gate_metrics(
    gold: DataFrame,
    companies_raw: DataFrame,
    as_of: str | dt.date,
    floor: str | dt.date = DEFAULT_DATE_FLOOR,
    rules: GateRules = GateRules(),
) -> DataFrame:
    """All gates as rows ``(gate, value, rule, passed)``; a null value fails."""
    # One row of decade statistics; the duplicate count and the raw row count
    # enter as scalar sub-queries.
    one = _decade_stats(gold, as_of, floor).select(
        "*",
        gate_duplicates(gold).scalar().alias("duplicates"),
        companies_raw.agg(F.count(F.lit(1))).scalar().alias("bronze_rows"),
    )
    return _gate_rows(one, rules)


def _gate_rows(one: DataFrame, rules: GateRules) -> DataFrame:
    """The gates of one row of measures."""
    retention = pct(F.col("rows"), F.col("bronze_rows"), 2)
    r = rules
    gates = [
        ("volume", F.col("rows"), f"> {r.min_rows}", F.col("rows") > r.min_rows),
        ("retention", retention, f"> {r.min_retention_pct}", retention > r.min_retention_pct),
        ("duplicates", F.col("duplicates"), f"<= {r.max_duplicates}", F.col("duplicates") <= r.max_duplicates),
        ("null_dates", F.col("null_dates"), f"<= {r.max_null_dates}", F.col("null_dates") <= r.max_null_dates),
        ("date_range", F.col("out_of_range"), f"<= {r.max_out_of_range}", F.col("out_of_range") <= r.max_out_of_range),
        ("decade_concentration", F.col("decade_pct"), f"< {r.max_decade_pct}", F.col("decade_pct") < r.max_decade_pct),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("gate"),
                value.cast("double").alias("value"),
                F.lit(rule).alias("rule"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
            )
            for i, (name, value, rule, ok) in enumerate(gates)
        ]
    )
    return one.select(F.inline(rows))


class Measured:
    """Gold's measures, taken while it is written: rows, null and out-of-range dates, rows per decade.

    The decades between the date floor and ``as_of`` are counted one by one.  Should
    rows of other decades be written, the concentration is taken from the files.
    """

    def __init__(self, as_of: str | dt.date, floor: str | dt.date = DEFAULT_DATE_FLOOR):
        self.as_of, self.floor = as_of, floor
        self.decades = range(int(str(floor)[:4]) // 10 * 10, int(str(as_of)[:4]) + 1, 10)
        self.seen = Observation(f"gold {uuid.uuid4().hex}")

    def observe(self, gold: DataFrame) -> DataFrame:
        d, decade = F.col("opened_on"), decade_of(F.col("opened_on"))
        return gold.observe(
            self.seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(d.isNull()).alias("null_dates"),
            F.count_if((d < _date_lit(self.floor)) | (d > _date_lit(self.as_of))).alias("out_of_range"),
            *[F.count_if(decade == x).alias(f"decade {x}") for x in self.decades],
        )

    def gate_metrics(self, staged: DataFrame, bronze_rows: int, rules: GateRules = GateRules()) -> DataFrame:
        """All gates as rows, like :func:`gate_metrics`; only the keys of the written files are read again."""
        seen = self.seen.get
        counts = [seen["null_dates"], *(seen[f"decade {x}"] for x in self.decades)]
        if sum(counts) == seen["rows"]:
            share = pct(F.lit(max(counts)), F.lit(seen["rows"]), 1)
        else:
            share = gate_decade_concentration(staged).scalar()
        return _gate_rows(
            gate_duplicates(staged).select(
                F.col("value").alias("duplicates"),
                *[F.lit(seen[k]).cast("bigint").alias(k) for k in ("rows", "null_dates", "out_of_range")],
                F.lit(bronze_rows).cast("bigint").alias("bronze_rows"),
                share.alias("decade_pct"),
            ),
            rules,
        )


def run_gates(metrics: DataFrame) -> list[tuple]:
    """Evaluate the gate table on the driver (six rows) and raise on failure."""
    rows = [tuple(r) for r in metrics.orderBy("position").collect()]
    failed = [r[1] for r in rows if not r[4]]
    if failed:
        raise GateFailure(failed, rows)
    return rows
