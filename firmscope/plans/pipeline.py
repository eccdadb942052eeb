"""The monthly load: raw shards -> Bronze -> Gold (gated) -> marts.

Layout below ``warehouse`` (a shared folder)::

    bronze/v-<id>/companies_raw, establishments_raw    both tables of a load; bronze/_pointers/
    quarantine/<run id>/                               rejected rows with the reason
    gold/v-<id>/ ... gold/_pointers/<time>-<id>       versions + pointer files
    marts/<name>/v-<id>/ ... marts/<name>/_pointers/
    audit/                                             gates, quarantine reasons and
                                                       parse counters of every run

Write-audit-publish: Bronze is written (committed) first, so a failed gate does
not cost the ingest again; Gold is written to a new version, the gates run on
the *written* files, and the pointer moves only when every gate passes.  A
failed run leaves the previous Gold and marts current.  Each mart is rebuilt
from the published Gold and swapped independently; one failing mart does not
stop the others.
"""

from __future__ import annotations

import datetime as dt
import inspect
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import gates, gold, listing, mart_states, marts
from firmscope.operators.gates import GateFailure, GateRules
from firmscope.plans import store
from firmscope.session import size_shuffles
from firmscope.sources import keyed, zipshards

COMPANIES_PATTERN = "Empresas*.zip"
ESTABLISHMENTS_PATTERN = "Estabelecimentos*.zip"


AUDIT_SCHEMA = "run_id string, version string, kind string, name string, value double, passed boolean"


@dataclass
class Lookups:
    activity: DataFrame
    city: DataFrame
    legal_nature: DataFrame | None = None


MartBuilder = Callable[..., DataFrame]


def _counts(g: DataFrame, built: dict[str, DataFrame]) -> DataFrame:
    # the stored (year, city, state) counts when the rebuild wrote them, else Gold
    if "city_year_counts" in built:
        return built["city_year_counts"]
    return marts.city_year_counts(g)


def default_marts(survival_min_count: int = 1000, pad: int | None = 7) -> dict[str, MartBuilder]:
    """The mart registry rebuilt after every Gold publication.

    Builders take (gold, lookups) or (gold, lookups, built), where ``built``
    holds the marts already written in this rebuild, read back from storage:
    growth and bubbles derive from the stored (year, city, state) counts and the
    density from the regional KPIs, so Gold is scanned four times for seven marts, and once
    for each of the two side tables.
    """
    return {
        "city_year_counts": lambda g, lk: marts.city_year_counts(g),
        "growth_by_city": lambda g, lk, built: marts.growth_by_city(_counts(g, built), lk.city),
        "bubbles_year_city": lambda g, lk, built: marts.bubbles_year_city(_counts(g, built), lk.city),
        "sector_treemap": lambda g, lk: marts.sector_treemap(g, pad),
        "region_kpis": lambda g, lk: marts.region_kpis(g),
        "density_by_state": lambda g, lk, built: (
            marts.density_from_kpis(built["region_kpis"]) if "region_kpis" in built else marts.density_by_state(g)
        ),
        "survival_by_sector": lambda g, lk: marts.survival_by_sector(g, lk.activity, survival_min_count),
        # Side tables of the preview and the ranking.
        "opening_days": lambda g, lk: listing.opening_days(g),
        "capital_leaders": lambda g, lk: listing.capital_leaders(g),
    }


@dataclass
class LoadConfig:
    warehouse: str
    as_of: dt.date | str
    date_floor: str = "1900-01-01"
    rules: GateRules = field(default_factory=GateRules)
    source_dir: str | None = None
    reuse_bronze: bool = False
    part_bytes: int = 128 << 20
    buckets: int | None = None  # Bronze is kept by the padded key in so many buckets, see sources.keyed
    keep_versions: int = 3  # of Bronze, Gold and each mart, after a publication


@dataclass
class LoadResult:
    run_id: str
    published: bool
    gold_path: str | None
    gate_rows: list[tuple]
    failed: list[str]
    marts: list[tuple] = field(default_factory=list)


def bronze_paths(spark: SparkSession, warehouse: str) -> tuple[str, str] | None:
    """The two tables of the current Bronze version: always of one load."""
    version = store.current(spark, f"{warehouse}/bronze")
    return None if version is None else (f"{version}/companies_raw", f"{version}/establishments_raw")


def bronze_ready(spark: SparkSession, warehouse: str) -> bool:
    """A Bronze version is published and both its tables are non-empty."""
    paths = bronze_paths(spark, warehouse)
    return paths is not None and not any(spark.read.parquet(p).isEmpty() for p in paths)


def write_bronze(
    companies_raw: DataFrame, establishments_raw: DataFrame, warehouse: str, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Write both tables to a new version; one pointer makes the pair current.

    If either write fails, the version before stays current, whole.  With ``buckets``
    both tables get the padded key as a column and are kept by it: the Gold build and the
    duplicate gate then join and group them without an exchange, load after load.
    """
    spark = companies_raw.sparkSession
    version = store.new_version_path(spark, f"{warehouse}/bronze")
    for name, raw in (("companies_raw", companies_raw), ("establishments_raw", establishments_raw)):
        if buckets is None:
            raw.write.parquet(f"{version}/{name}")
        else:
            keyed.write_keyed(raw.withColumn("company_id", gold.company_key(raw)), f"{version}/{name}", "company_id", buckets)
    store.publish(spark, f"{warehouse}/bronze", version)
    return read_bronze(spark, warehouse)


def read_bronze(spark: SparkSession, warehouse: str) -> tuple[DataFrame, DataFrame]:
    paths = bronze_paths(spark, warehouse)
    if paths is None:
        raise FileNotFoundError(f"no published Bronze under {warehouse}")
    return tuple(keyed.read_keyed(spark, p) if keyed.is_keyed(spark, p) else spark.read.parquet(p) for p in paths)


def ingest_bronze(spark: SparkSession, cfg: LoadConfig) -> tuple[DataFrame, DataFrame]:
    """Expand the zipped shards and write both Bronze tables as Parquet."""
    if cfg.source_dir is None:
        raise ValueError("source_dir is required to ingest")
    scratch = f"{cfg.warehouse}/_expanded/{uuid.uuid4().hex}"
    comp, comp_manifest = zipshards.ingest_zip_shards(
        spark, cfg.source_dir, COMPANIES_PATTERN, schemas.COMPANIES_RAW, f"{scratch}/companies", cfg.part_bytes
    )
    est, est_manifest = zipshards.ingest_zip_shards(
        spark, cfg.source_dir, ESTABLISHMENTS_PATTERN, schemas.ESTABLISHMENTS_RAW, f"{scratch}/establishments", cfg.part_bytes
    )
    # NUL bytes removed per archive, kept with the run audit.
    ingest_id = uuid.uuid4().hex
    nul = comp_manifest.unionByName(est_manifest).groupBy("archive").agg(F.sum("nul_removed").alias("n"))
    audit = nul.select(
        F.lit(ingest_id).alias("run_id"),
        F.lit(None).cast("string").alias("version"),
        F.lit("ingest_nul_removed").alias("kind"),
        F.col("archive").alias("name"),
        F.col("n").cast("double").alias("value"),
        F.lit(None).cast("boolean").alias("passed"),
    )
    audit.write.mode("append").parquet(f"{cfg.warehouse}/audit")
    out = write_bronze(comp, est, cfg.warehouse, cfg.buckets)
    store.fs(spark, scratch).delete(scratch)  # the expanded text has become Bronze
    store.retain(spark, f"{cfg.warehouse}/bronze", cfg.keep_versions)
    return out


def publish_if_valid(
    spark: SparkSession,
    companies_raw: DataFrame,
    establishments_raw: DataFrame,
    cfg: LoadConfig,
    raise_on_failure: bool = True,
) -> LoadResult:
    """Build Gold into a new version, gate it, publish it only when valid."""
    run_id = uuid.uuid4().hex
    gold_base = f"{cfg.warehouse}/gold"
    version = store.new_version_path(spark, gold_base)
    built = gold.build_gold(companies_raw, establishments_raw, cfg.as_of, cfg.date_floor)
    # Measured while they are written, after the last exchange: a task that runs again counts once.
    written = gates.Measured(cfg.as_of, cfg.date_floor)
    written.observe(gold.gold_layout(built)).write.mode("overwrite").parquet(version)
    staged = gold.read_gold_files(spark, version)

    parsed = gold.capital_parse_report(companies_raw).first()  # one scan of the companies: their number, and what couldn't be parsed
    metrics = written.gate_metrics(staged, parsed.companies, cfg.rules)
    _, rejected = gold.quarantine_split(establishments_raw, cfg.as_of, cfg.date_floor)
    quarantine = f"{cfg.warehouse}/quarantine/{run_id}"
    reasons = Observation(f"quarantine {run_id}")
    rejected.observe(reasons, *gold.reason_counts()).write.parquet(quarantine)  # the rows themselves, with the reason (D3)
    audit = metrics.select(
        F.lit(run_id).alias("run_id"),
        F.lit(version).alias("version"),
        F.lit("gate").alias("kind"),
        F.col("gate").alias("name"),
        F.col("value"),
        F.col("passed"),
    )
    counted = [(run_id, version, "quarantine", reason, float(n), None) for reason, n in reasons.get.items() if n]
    counted.append((run_id, version, "parse", "unparsable_capital", float(parsed.unparsable_capital), None))
    audit = audit.unionByName(spark.createDataFrame(counted, AUDIT_SCHEMA))
    audit.write.mode("append").parquet(f"{cfg.warehouse}/audit")
    this_run = spark.read.parquet(f"{cfg.warehouse}/audit").where(F.col("run_id") == run_id)
    gate_rows = [
        tuple(r)
        for r in this_run.where(F.col("kind") == "gate").select("name", "value", "passed").collect()
    ]
    failed = sorted(name for name, _, ok in gate_rows if not ok)
    if failed:
        result = LoadResult(run_id, False, store.current(spark, gold_base), gate_rows, failed)
        if raise_on_failure:
            raise GateFailure(failed, gate_rows)
        return result
    store.publish(spark, gold_base, version)
    store.retain(spark, gold_base, cfg.keep_versions)
    return LoadResult(run_id, True, version, gate_rows, [])


def rebuild_marts(
    spark: SparkSession,
    gold_df: DataFrame | None,
    lookups: Lookups,
    warehouse: str,
    registry: dict[str, MartBuilder] | None = None,
    keep_versions: int = 3,
) -> list[tuple]:
    """Rebuild every mart from ``gold_df``; each is written to a new version and
    swapped in.  Returns ``(mart, ok, version_or_error)`` per mart (S11, S12)."""
    out = []
    built: dict[str, DataFrame] = {}
    for name, build in (registry or default_marts()).items():
        base = f"{warehouse}/marts/{name}"
        try:
            version = store.new_version_path(spark, base)
            wants_built = len(inspect.signature(build).parameters) >= 3
            df = build(gold_df, lookups, built) if wants_built else build(gold_df, lookups)
            df.write.parquet(version)
            store.publish(spark, base, version)
            store.retain(spark, base, keep_versions)
            built[name] = spark.read.parquet(version)
            out.append((name, True, version))
        except Exception as exc:  # noqa: BLE001 - one failing mart must not stop the rest
            out.append((name, False, f"{type(exc).__name__}: {exc}"[:500]))
    return out


def current_states(spark: SparkSession, warehouse: str) -> tuple[str, dict[str, DataFrame]] | None:
    """The Gold version that the published mart states describe, and the states."""
    version = store.current(spark, f"{warehouse}/mart_states")
    if version is None:
        return None
    described = store.fs(spark, version).read_text(f"{version}/gold_version").strip()
    return described, {name: spark.read.parquet(f"{version}/{name}") for name in mart_states.STATES}


def maintain_marts(
    spark: SparkSession,
    warehouse: str,
    lookups: Lookups,
    survival_min_count: int = 1000,
    pad: int | None = 7,
    keep_versions: int = 3,
) -> list[tuple]:
    """Bring the mart states to the current Gold version, and every mart from them.

    The states of the version before, if that Gold version is still there, are changed
    by the difference of the two; otherwise they are built from Gold.  They are
    published together, with the version they describe, before the marts: a run that
    ends early leaves states and marts of the version before, each whole.
    """
    version = store.current(spark, f"{warehouse}/gold")
    if version is None:
        raise FileNotFoundError(f"no published Gold under {warehouse}")
    before = current_states(spark, warehouse)
    if before is None or before[0] != version:
        new = gold.read_gold_files(spark, version)
        known = before is not None and store.fs(spark, before[0]).exists(before[0])
        target = store.new_version_path(spark, f"{warehouse}/mart_states")
        rows = mart_states.whole(new)
        if known:
            change = f"{target}/change"
            mart_states.difference(gold.read_gold_files(spark, before[0]), new).write.parquet(change)
            rows = spark.read.parquet(change)
        for name in mart_states.STATES:
            state = mart_states.state_of(name, rows)
            (mart_states.updated(name, before[1][name], state) if known else state).write.parquet(f"{target}/{name}")
        store.fs(spark, target).write_text(f"{target}/gold_version", version)
        store.publish(spark, f"{warehouse}/mart_states", target)
        store.retain(spark, f"{warehouse}/mart_states", keep_versions)
    states = current_states(spark, warehouse)[1]
    counts = mart_states.city_year_counts(states["openings"])
    registry = {
        "city_year_counts": lambda g, lk: counts,
        "growth_by_city": lambda g, lk: marts.growth_by_city(counts, lk.city),
        "bubbles_year_city": lambda g, lk: marts.bubbles_year_city(counts, lk.city),
        "sector_treemap": lambda g, lk: mart_states.sector_treemap(states["sectors"], pad),
        "region_kpis": lambda g, lk: mart_states.region_kpis(states["regions"]),
        "density_by_state": lambda g, lk: marts.density_from_kpis(mart_states.region_kpis(states["regions"])),
        "survival_by_sector": lambda g, lk: marts.survival_of_lifetimes(states["lifetimes"], lk.activity, survival_min_count),
    }
    return rebuild_marts(spark, None, lookups, warehouse, registry, keep_versions)


def read_mart(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    return store.read_current(spark, f"{warehouse}/marts/{name}")


def read_gold(spark: SparkSession, warehouse: str) -> DataFrame:
    path = store.current(spark, f"{warehouse}/gold")
    if path is None:
        raise FileNotFoundError(f"no published Gold under {warehouse}")
    return gold.read_gold_files(spark, path)


def run_load(spark: SparkSession, cfg: LoadConfig, lookups: Lookups, registry=None) -> LoadResult:
    """Whole load: Bronze (reused when asked and present), gated Gold, marts."""
    if cfg.reuse_bronze and bronze_ready(spark, cfg.warehouse):
        comp, est = read_bronze(spark, cfg.warehouse)
    else:
        comp, est = ingest_bronze(spark, cfg)
    paths = bronze_paths(spark, cfg.warehouse)
    size_shuffles(spark, sum(size for p in paths for _, size, _ in store.fs(spark, p).files(p)))
    result = publish_if_valid(spark, comp, est, cfg)
    result.marts = rebuild_marts(spark, read_gold(spark, cfg.warehouse), lookups, cfg.warehouse, registry,
                                 cfg.keep_versions)
    return result
