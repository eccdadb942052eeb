"""Catalogue entries for the load pipeline: Gold build, quarantine, gates,
write-audit-publish, mart rebuild, shard ingest, delimited scan and export.

Entries that write files do so in a fresh folder below the shared folder
(``spark.checkpoint.dir``), never in a machine-local one.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import gates, gold, layout, listing, mart_states, marts
from firmscope.operators.gates import GateRules
from firmscope.plans import pipeline
from firmscope.plans.catalog import _SQL, AS_OF, PAD, Ctx, query
from firmscope.plans.oracle import PCT
from firmscope.session import shared_dir, size_shuffles
from firmscope.sources import delimited, export, keyed, zipshards
from firmscope.sources import driver_tables as dtab


def _scratch(c: Ctx, name: str) -> str:
    return f"{shared_dir(c.spark)}/firmscope-scratch/{name}-{uuid.uuid4().hex}"


def _keyed_gold(c: Ctx) -> DataFrame:
    """Gold built from raw tables that are kept by key, in buckets whose number follows the input's size."""
    buckets = keyed.buckets_for(dtab.input_bytes(c.spark, c.sf_dir, ["lineitem", "orders", "customer", "supplier"]))
    return gold.build_gold(*pipeline.write_bronze(c.companies_raw, c.establishments_raw, _scratch(c, "keyed"), buckets=buckets), AS_OF)


_OPEN_OK = (
    "COALESCE(regexp_full_match(data_inicio_atividade, '[0-9]{8}') AND "
    "CAST(try_strptime(data_inicio_atividade, '%Y%m%d') AS DATE) BETWEEN DATE '1900-01-01' "
    f"AND DATE '{AS_OF}', FALSE)"
)


@query(
    "build_gold",
    """
    SELECT company_id, legal_name, legal_nature_code, CAST(share_capital AS DOUBLE) AS share_capital,
           opened_on, activity_code, city_code, state, status_code, status_on
    FROM gold_built
    """,
)
def _build_gold(c: Ctx) -> DataFrame:
    return c.built_gold()


@query(
    "quarantine_split",
    f"""
    SELECT lpad(cnpj_basico, 8, '0') AS company_id, data_inicio_atividade AS raw_opened_on,
           CASE WHEN data_inicio_atividade IS NULL THEN 'missing'
                WHEN NOT regexp_full_match(data_inicio_atividade, '[0-9]{{8}}') THEN 'malformed'
                WHEN try_strptime(data_inicio_atividade, '%Y%m%d') IS NULL THEN 'impossible_date'
                WHEN CAST(try_strptime(data_inicio_atividade, '%Y%m%d') AS DATE) < DATE '1900-01-01'
                     THEN 'before_floor'
                WHEN CAST(try_strptime(data_inicio_atividade, '%Y%m%d') AS DATE) > DATE '{AS_OF}'
                     THEN 'after_as_of'
           END AS reason
    FROM establishments_raw
    WHERE matriz_filial = '1' AND NOT {_OPEN_OK}
    """,
)
def _quarantine_split(c: Ctx) -> DataFrame:
    _, rejected = gold.quarantine_split(c.establishments_raw, AS_OF)
    return rejected


@query(
    "quarantine_count",
    f"SELECT COUNT(*) FILTER (WHERE NOT {_OPEN_OK}) AS quarantined FROM establishments_raw WHERE matriz_filial = '1'",
)
def _quarantine_count(c: Ctx) -> DataFrame:
    return gold.quarantine_count(c.establishments_raw, AS_OF)


@query("gate_volume", "SELECT COUNT(*) AS value FROM gold_built")
def _gate_volume(c: Ctx) -> DataFrame:
    return gates.gate_volume(c.built_gold())


@query(
    "gate_retention",
    f"SELECT {PCT('(SELECT COUNT(*) FROM gold_built)', '(SELECT COUNT(*) FROM companies_raw)', 2)} AS value",
)
def _gate_retention(c: Ctx) -> DataFrame:
    return gates.gate_retention(c.built_gold(), c.companies_raw)


@query("gate_duplicates", "SELECT COUNT(*) - COUNT(DISTINCT company_id) AS value FROM gold_built")
def _gate_duplicates(c: Ctx) -> DataFrame:
    return gates.gate_duplicates(c.built_gold())


@query("build_gold_keyed", "SELECT * FROM (" + _SQL["build_gold"] + ") g")
def _build_gold_keyed(c: Ctx) -> DataFrame:
    return _keyed_gold(c)


@query("gate_duplicates_keyed", "SELECT * FROM (" + _SQL["gate_duplicates"] + ") g")
def _gate_duplicates_keyed(c: Ctx) -> DataFrame:
    return gates.gate_duplicates(_keyed_gold(c))


@query("gate_null_dates", "SELECT COUNT(*) FILTER (WHERE opened_on IS NULL) AS value FROM gold_built")
def _gate_null_dates(c: Ctx) -> DataFrame:
    return gates.gate_null_dates(c.built_gold())


@query(
    "gate_date_range",
    f"""
    SELECT COUNT(*) FILTER (WHERE opened_on < DATE '1900-01-01' OR opened_on > DATE '{AS_OF}') AS value
    FROM gold_built
    """,
)
def _gate_date_range(c: Ctx) -> DataFrame:
    return gates.gate_date_range(c.built_gold(), AS_OF)


_DECADES = "SELECT COUNT(*) AS c FROM gold_built GROUP BY CAST(EXTRACT(year FROM opened_on) AS INTEGER) // 10"


@query("gate_decade_concentration", f"SELECT {PCT('MAX(c)', 'SUM(c)', 1)} AS value FROM ({_DECADES}) t")
def _gate_decade_concentration(c: Ctx) -> DataFrame:
    return gates.gate_decade_concentration(c.built_gold())


def _run_gates_sql() -> str:
    r = GateRules()
    return f"""
    WITH g AS (SELECT COUNT(*) AS rows,
                      COUNT(*) - COUNT(DISTINCT company_id) AS duplicates,
                      COUNT(*) FILTER (WHERE opened_on IS NULL) AS null_dates,
                      COUNT(*) FILTER (WHERE opened_on < DATE '1900-01-01' OR opened_on > DATE '{AS_OF}') AS oor
               FROM gold_built),
    d AS (SELECT {PCT('MAX(c)', 'SUM(c)', 1)} AS decade_pct FROM ({_DECADES}) t),
    b AS (SELECT COUNT(*) AS bronze_rows FROM companies_raw),
    m AS (SELECT g.*, d.decade_pct, {PCT('g.rows', 'b.bronze_rows', 2)} AS retention FROM g, d, b)
    SELECT 1 AS position, 'volume' AS gate, CAST(rows AS DOUBLE) AS value, '> {r.min_rows}' AS rule,
           COALESCE(rows > {r.min_rows}, FALSE) AS passed FROM m
    UNION ALL SELECT 2, 'retention', retention, '> {r.min_retention_pct}',
           COALESCE(retention > {r.min_retention_pct}, FALSE) FROM m
    UNION ALL SELECT 3, 'duplicates', CAST(duplicates AS DOUBLE), '<= {r.max_duplicates}',
           COALESCE(duplicates <= {r.max_duplicates}, FALSE) FROM m
    UNION ALL SELECT 4, 'null_dates', CAST(null_dates AS DOUBLE), '<= {r.max_null_dates}',
           COALESCE(null_dates <= {r.max_null_dates}, FALSE) FROM m
    UNION ALL SELECT 5, 'date_range', CAST(oor AS DOUBLE), '<= {r.max_out_of_range}',
           COALESCE(oor <= {r.max_out_of_range}, FALSE) FROM m
    UNION ALL SELECT 6, 'decade_concentration', decade_pct, '< {r.max_decade_pct}',
           COALESCE(decade_pct < {r.max_decade_pct}, FALSE) FROM m
    """


@query("run_gates", _run_gates_sql())
def _run_gates(c: Ctx) -> DataFrame:
    return gates.gate_metrics(c.built_gold(), c.companies_raw, AS_OF)


def _publish_sql() -> str:
    return f"""
    SELECT 'gate' AS kind, gate AS name, value, passed, FALSE AS published FROM ({_run_gates_sql().replace(f"> {GateRules().min_rows}", "> 1")}) g
    UNION ALL
    SELECT 'quarantine', reason, CAST(COUNT(*) AS DOUBLE), NULL, FALSE FROM ({_SQL["quarantine_split"]}) q GROUP BY reason
    UNION ALL
    SELECT 'parse', 'unparsable_capital', CAST(COUNT(*) FILTER (
             WHERE capital_social IS NOT NULL AND TRY_CAST(replace(capital_social, ',', '.') AS DECIMAL(20,2)) IS NULL) AS DOUBLE),
           NULL, FALSE
    FROM companies_raw
    """


@query("publish_if_valid", _publish_sql())
def _publish_if_valid(c: Ctx) -> DataFrame:
    """Gated load of the Bronze-shaped tables into a fresh warehouse.

    On the test tables the duplicate and decade gates fail by design, so the
    result shows the gate rows and ``published = false``.
    """
    warehouse = _scratch(c, "warehouse")
    comp, est = pipeline.write_bronze(c.companies_raw, c.establishments_raw, warehouse)
    cfg = pipeline.LoadConfig(warehouse=warehouse, as_of=AS_OF, rules=GateRules(min_rows=1))
    result = pipeline.publish_if_valid(c.spark, comp, est, cfg, raise_on_failure=False)
    audit = c.spark.read.parquet(f"{warehouse}/audit").where(F.col("run_id") == result.run_id)
    return audit.select("kind", "name", "value", "passed", F.lit(result.published).alias("published"))


_LENIENT = GateRules(min_rows=1, min_retention_pct=1.0, max_duplicates=10**9, max_decade_pct=101.0)


@query(
    "publish_passing",
    f"""
    SELECT 'gate' AS kind, gate AS name, value, TRUE AS passed FROM ({_run_gates_sql()}) g
    UNION ALL SELECT 'published', 'gold', CAST(COUNT(*) AS DOUBLE), TRUE FROM gold_built
    UNION ALL SELECT 'published', 'capital', CAST(SUM(share_capital) AS DOUBLE), TRUE FROM gold_built
    """,
)
def _publish_passing(c: Ctx) -> DataFrame:
    """A load whose gates pass, by lenient rules: the gate rows, and rows and capital of the Gold that it published."""
    warehouse = _scratch(c, "warehouse")
    comp, est = pipeline.write_bronze(c.companies_raw, c.establishments_raw, warehouse)
    cfg = pipeline.LoadConfig(warehouse=warehouse, as_of=AS_OF, rules=_LENIENT)
    result = pipeline.publish_if_valid(c.spark, comp, est, cfg)
    audit = c.spark.read.parquet(f"{warehouse}/audit").where((F.col("run_id") == result.run_id) & (F.col("kind") == "gate"))
    published = pipeline.read_gold(c.spark, warehouse).agg(
        F.count(F.lit(1)).cast("double").alias("gold"), F.sum("share_capital").cast("double").alias("capital")
    )
    told = published.select(F.inline(F.array(*[F.struct(F.lit("published").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("gold", "capital")])))
    return audit.select("kind", "name", "value", "passed").union(told.withColumn("passed", F.lit(result.published)))


# Of each mart its rows and the sum of a measure.
_MARTS = {
    "city_year_counts": (
        "n",
        "SELECT COUNT(*) AS n FROM companies WHERE opened_on IS NOT NULL AND city_code IS NOT NULL"
        " GROUP BY EXTRACT(year FROM opened_on), city_code, state",
    ),
    "growth_by_city": ("total", "SELECT * FROM growth_mart"),
    "bubbles_year_city": ("mean_capital", "SELECT * FROM bubbles_mart"),
    "sector_treemap": ("total_capital", "SELECT * FROM treemap_mart"),
    "region_kpis": ("mean_capital", _SQL["region_kpis"]),
    "density_by_state": ("total", "SELECT COUNT(*) AS total FROM companies WHERE state IS NOT NULL GROUP BY state"),
    "survival_by_sector": ("p95", "SELECT * FROM survival_mart"),
    "opening_days": ("n", "SELECT COUNT(*) AS n FROM companies WHERE share_capital > 0 AND opened_on IS NOT NULL GROUP BY opened_on"),
    "capital_leaders": (
        "share_capital",
        "SELECT share_capital FROM companies WHERE share_capital > 0 AND share_capital > COALESCE("
        "(SELECT share_capital FROM companies WHERE share_capital > 0 ORDER BY share_capital DESC LIMIT 1 OFFSET 1000), 0)",
    ),
}


@query(
    "rebuild_marts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS mart, TRUE AS ok, COUNT(*) AS rows, CAST(SUM(CAST({measure} AS DECIMAL(38,2))) AS DOUBLE) AS total FROM ({sql}) t"
        for name, (measure, sql) in _MARTS.items()
    ),
)
def _rebuild_marts(c: Ctx) -> DataFrame:
    """Rebuild the mart registry from the Gold-shaped table into a fresh warehouse: each mart's rows and the sum of a measure."""
    warehouse = _scratch(c, "marts")
    lk = pipeline.Lookups(c.ref_activity, c.ref_city, c.ref_legal_nature)
    done = pipeline.rebuild_marts(c.spark, c.companies, lk, warehouse, pipeline.default_marts(dtab.SURVIVAL_MIN_COUNT, PAD))
    frames = [
        pipeline.read_mart(c.spark, warehouse, name).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col(_MARTS[name][0]).cast("decimal(30,2)")).cast("double").alias("total")
        ).select(F.lit(name).alias("mart"), F.lit(True).alias("ok"), "rows", "total")
        if ok
        else c.spark.createDataFrame([(name, False, 0, None)], "mart string, ok boolean, rows bigint, total double")
        for name, ok, _ in done
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _raw_sql(columns: list[str], source: str, given: set[str]) -> str:
    cells = ", ".join(c if c in given else f"CAST(NULL AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT {cells} FROM {source}"


@query(
    "ingest_zip_shards",
    _raw_sql(
        schemas.COMPANIES_RAW.names, "companies_raw", {"cnpj_basico", "razao_social", "natureza_juridica", "capital_social"}
    ),
)
def _ingest_zip_shards(c: Ctx) -> DataFrame:
    """Companies file written as zipped shards, one for each partition, then ingested back."""
    src = _scratch(c, "zips")
    zipshards.write_zip_shards(c.companies_raw, src, "Empresas")
    rows, _ = zipshards.ingest_zip_shards(
        c.spark, src, "Empresas*.zip", schemas.COMPANIES_RAW, f"{src}/expanded", part_bytes=64 << 10
    )
    return rows


@query(
    "archive_running_total",
    """
    SELECT 'Empresas' || digit || '.zip' AS archive, COUNT(*) AS rows,
           CAST(SUM(COUNT(*)) OVER (ORDER BY digit) AS BIGINT) AS running_total
    FROM (SELECT right(cnpj_basico, 1) AS digit FROM companies_raw) t GROUP BY digit
    """,
)
def _archive_running_total(c: Ctx) -> DataFrame:
    """Rows per archive with the running total: an archive for each last digit of the key, written and ingested."""
    src = _scratch(c, "zips")
    zipshards.write_zip_shards(c.companies_raw, src, "Empresas", by=F.right("cnpj_basico", F.lit(1)))
    rows, manifest = zipshards.ingest_zip_shards(c.spark, src, "Empresas*.zip", schemas.COMPANIES_RAW, f"{src}/expanded")
    totals = zipshards.archive_running_total(manifest, rows)
    return totals.select(F.regexp_extract("shard", "[^/]+$", 0).alias("archive"), "rows", "running_total")


@query(
    "scan_delimited",
    _raw_sql(
        schemas.ESTABLISHMENTS_RAW_COLUMNS,
        "establishments_raw",
        {
            "cnpj_basico", "matriz_filial", "situacao_cadastral", "data_situacao", "data_inicio_atividade",
            "cnae_fiscal", "uf", "municipio",
        },
    ),
)
def _scan_delimited(c: Ctx) -> DataFrame:
    """Establishments files written in the registry dialect and scanned back, by byte ranges."""
    out = _scratch(c, "csv")
    c.establishments_raw.write.mode("overwrite").options(**zipshards.REGISTRY_CSV_WRITE).csv(out)
    return delimited.scan_splittable(c.spark, out, schemas.ESTABLISHMENTS_RAW)


@query(
    "export_csv",
    """
    SELECT region, CAST(total_companies AS VARCHAR) AS total_companies,
           CAST(CAST(mean_capital AS DECIMAL(28,2)) AS VARCHAR) AS mean_capital, CAST(pct_active AS VARCHAR) AS pct_active
    FROM (""" + _SQL["region_kpis"] + ") k",
)
def _export_csv(c: Ctx) -> DataFrame:
    """Regional KPIs exported as a dated ``;`` CSV with BOM and read back."""
    out = _scratch(c, "export")
    path = export.export_csv(marts.region_kpis(c.companies), out, "comparison_kpis", on=_dt.date(2002, 1, 1))
    return export.read_export(c.spark, path)


# Every second description of the options gets accents, so that the order of letters and of bytes differ.
_ACCENTS = "CASE WHEN length(description) % 2 = 1 THEN translate(description, 'aeou', 'áéóú') ELSE description END"


@query(
    "filter_options_sorted",
    f"""
    WITH options AS (
      SELECT DISTINCT 'sector' AS kind, {_ACCENTS} AS description FROM ref_activity
      UNION ALL SELECT DISTINCT 'city', {_ACCENTS} FROM ref_city)
    SELECT kind, description,
           dense_rank() OVER (PARTITION BY kind ORDER BY strip_accents(lower(description)), lower(description), description) AS place
    FROM options
    """,
)
def _filter_options_sorted(c: Ctx) -> DataFrame:
    """The option lists with each description's place in accent-aware order; half of the descriptions have accents."""
    accented = [ref.withColumn("description", F.expr(_ACCENTS)) for ref in (c.ref_activity, c.ref_city)]
    return listing.ranked_options(listing.filter_options(*accented)).select("kind", "description", "place")


def _previous_gold(c: Ctx) -> DataFrame:
    """A Gold version as of before: some companies not there yet, some gone since, some changed."""
    g = c.companies
    digits = F.pmod(F.xxhash64("company_id"), F.lit(20))
    changed = g.where(digits != 0).withColumns(
        {
            "share_capital": F.when(digits == 1, F.col("share_capital") + 100).otherwise(F.col("share_capital")).cast(g.schema["share_capital"].dataType),
            "status_code": F.when(digits == 2, F.lit(2)).otherwise(F.col("status_code")).cast(g.schema["status_code"].dataType),
            "city_code": F.when(digits == 3, F.lit(None)).otherwise(F.col("city_code")).cast(g.schema["city_code"].dataType),
            "state": F.when(digits == 4, F.lit("GONE")).otherwise(F.col("state")),
            "status_on": F.when(digits == 5, F.date_add("status_on", 40)).otherwise(F.col("status_on")),
        }
    )
    gone = g.where(digits == 6).withColumn("company_id", F.concat(F.lit("gone-"), "company_id"))
    return changed.unionByName(gone)


def _maintained(c: Ctx, name: str) -> DataFrame:
    """The state of the previous version, changed by the difference to the current one."""
    old, new = _previous_gold(c), c.companies
    # Both versions are compared: the tasks that hold their rows follow from the size.
    size_shuffles(c.spark, dtab.input_bytes(c.spark, c.sf_dir, ["lineitem", "orders"]), dtab.PART_BYTES)
    before = mart_states.state_of(name, mart_states.whole(old))
    return mart_states.updated(name, before, mart_states.state_of(name, mart_states.difference(old, new, name)))


@query("maintained_growth_by_city", "SELECT * FROM growth_mart")
def _maintained_growth_by_city(c: Ctx) -> DataFrame:
    return marts.growth_by_city(mart_states.city_year_counts(_maintained(c, "openings")), c.ref_city)


@query("maintained_bubbles_year_city", "SELECT * FROM bubbles_mart")
def _maintained_bubbles_year_city(c: Ctx) -> DataFrame:
    return marts.bubbles_year_city(mart_states.city_year_counts(_maintained(c, "openings")), c.ref_city)


@query("maintained_sector_treemap", "SELECT * FROM treemap_mart")
def _maintained_sector_treemap(c: Ctx) -> DataFrame:
    return mart_states.sector_treemap(_maintained(c, "sectors"), PAD)


@query("maintained_region_kpis", "SELECT * FROM (" + _SQL["region_kpis"] + ") k")
def _maintained_region_kpis(c: Ctx) -> DataFrame:
    return mart_states.region_kpis(_maintained(c, "regions"))


@query("maintained_survival_by_sector", "SELECT * FROM survival_mart")
def _maintained_survival_by_sector(c: Ctx) -> DataFrame:
    return marts.survival_of_lifetimes(_maintained(c, "lifetimes"), c.ref_activity, dtab.SURVIVAL_MIN_COUNT)


_GOLD_SQL = (
    "SELECT company_id, legal_name, legal_nature_code, CAST(share_capital AS DOUBLE) AS share_capital, opened_on, activity_code,"
    " city_code, state, status_code, status_on FROM companies"
)


def _along_curve(c: Ctx) -> str:
    path = _scratch(c, "curve")
    layout.write_along_curve(c.companies, path)
    return path


@query("company_lookup", f"{_GOLD_SQL} WHERE company_id = '00000007'")
def _company_lookup(c: Ctx) -> DataFrame:
    """One company from Gold along the curve: the Bloom filters choose the row groups."""
    return layout.look_up(c.spark, _along_curve(c), company_id="00000007")


@query("city_lookup", f"{_GOLD_SQL} WHERE city_code = 3")
def _city_lookup(c: Ctx) -> DataFrame:
    """One city from Gold along the curve: statistics choose the row groups."""
    return layout.look_up(c.spark, _along_curve(c), city_code=3)
