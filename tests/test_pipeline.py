"""Gold build, quarantine, gates and write-audit-publish."""

import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.operators import gates, gold
from firmscope.operators.gates import GateFailure, GateRules
from firmscope.plans import pipeline, store
from tests.test_plans import plan_text

AS_OF = "2026-02-28"
LENIENT = GateRules(min_rows=1, min_retention_pct=50, max_decade_pct=101)


def _raw(spark, companies, establishments):
    comp = spark.createDataFrame(
        [(k, n, nat, None, cap, None, None) for k, n, nat, cap in companies], schemas.COMPANIES_RAW
    )
    est_rows = []
    for k, head, opened, activity, city, uf, status, status_on in establishments:
        row = dict.fromkeys(schemas.ESTABLISHMENTS_RAW_COLUMNS)
        row.update(
            cnpj_basico=k, matriz_filial=head, data_inicio_atividade=opened, cnae_fiscal=activity,
            municipio=city, uf=uf, situacao_cadastral=status, data_situacao=status_on,
        )
        est_rows.append(tuple(row[c] for c in schemas.ESTABLISHMENTS_RAW_COLUMNS))
    est = spark.createDataFrame(est_rows, schemas.ESTABLISHMENTS_RAW)
    return comp, est


@pytest.fixture()
def clean_raw(spark):
    companies = [
        ("1", "Alpha", "2062", "1000,50"),
        ("00000002", "Beta", "", None),
        ("3", "Gama", "2135", "abc"),
        ("4", "Delta", "2062", "10,00"),
    ]
    establishments = [
        ("00000001", "1", "20100115", "6201500", "7107", "SP", "2", "20100115"),
        ("00000001", "2", "20120101", "6201500", "7107", "SP", "2", "0"),
        ("2", "1", "19950301", "", "6001", "RJ", "8", "20200101"),
        ("3", "1", "20210231", "4711001", "6001", "RJ", "4", ""),
        ("4", "1", "20050505", "4711001", "6001", "RJ", "8", "00000000"),
        ("9", "1", "20050505", "4711001", "6001", "RJ", "2", "0"),
    ]
    return _raw(spark, companies, establishments)


def test_build_gold_types_and_one_row_per_company(clean_raw):
    comp, est = clean_raw
    g = gold.build_gold(comp, est, AS_OF)
    assert g.schema.names == schemas.GOLD_COLUMNS
    rows = {r.company_id: r for r in g.collect()}
    assert set(rows) == {"00000001", "00000002", "00000004"}  # 3 quarantined, 9 has no company row
    assert str(rows["00000001"].share_capital) == "1000.50"
    assert str(rows["00000002"].share_capital) == "0.00"
    assert rows["00000002"].legal_nature_code is None and rows["00000002"].activity_code is None
    assert rows["00000004"].status_on is None
    assert rows["00000001"].city_code == 7107 and rows["00000001"].status_code == 2


def test_quarantine_reasons_and_count(clean_raw):
    _, est = clean_raw
    _, rejected = gold.quarantine_split(est, AS_OF)
    assert [(r.company_id, r.reason) for r in rejected.collect()] == [("00000003", "impossible_date")]
    assert gold.quarantine_count(est, AS_OF).collect()[0].quarantined == 1


def test_row_accounting_invariant(clean_raw):
    """Gold + quarantined + non-head-office + unmatched = establishments."""
    comp, est = clean_raw
    g = gold.build_gold(comp, est, AS_OF).count()
    q = gold.quarantine_count(est, AS_OF).collect()[0].quarantined
    branches = est.where(F.col("matriz_filial") != "1").count()
    accepted, _ = gold.quarantine_split(est, AS_OF)
    keys = comp.select(F.lpad("cnpj_basico", 8, "0").alias("k"))
    unmatched = accepted.join(keys, F.lpad("cnpj_basico", 8, "0") == F.col("k"), "left_anti").count()
    assert g + q + branches + unmatched == est.count()


def test_gates_pass_on_clean_gold(clean_raw):
    comp, est = clean_raw
    metrics = gates.gate_metrics(gold.build_gold(comp, est, AS_OF), comp, AS_OF, rules=LENIENT)
    rows = gates.run_gates(metrics)
    assert [r[1] for r in rows] == [
        "volume", "retention", "duplicates", "null_dates", "date_range", "decade_concentration",
    ]


@pytest.mark.parametrize(
    "gate,rules,mutate",
    [
        ("volume", GateRules(min_rows=10, min_retention_pct=50, max_decade_pct=101), None),
        ("retention", GateRules(min_rows=1, min_retention_pct=90, max_decade_pct=101), None),
        ("duplicates", LENIENT, "dup"),
        ("null_dates", LENIENT, "null"),
        ("date_range", LENIENT, "old"),
        ("decade_concentration", GateRules(min_rows=1, min_retention_pct=50, max_decade_pct=30), None),
    ],
)
def test_each_gate_can_fail(spark, clean_raw, gate, rules, mutate):
    comp, est = clean_raw
    g = gold.build_gold(comp, est, AS_OF)
    if mutate == "dup":
        g = g.unionByName(g.limit(1))
    elif mutate == "null":
        g = g.withColumn("opened_on", F.when(F.col("company_id") == "00000001", None).otherwise(F.col("opened_on")))
    elif mutate == "old":
        g = g.withColumn("opened_on", F.when(F.col("company_id") == "00000001", F.lit("1850-01-01").cast("date")).otherwise(F.col("opened_on")))
    with pytest.raises(GateFailure) as err:
        gates.run_gates(gates.gate_metrics(g, comp, AS_OF, rules=rules))
    assert gate in err.value.failed


def test_failed_run_keeps_the_published_gold(spark, clean_raw, tmp_dir):
    comp, est = clean_raw
    good = pipeline.LoadConfig(warehouse=tmp_dir, as_of=AS_OF, rules=LENIENT)
    first = pipeline.publish_if_valid(spark, comp, est, good)
    assert first.published
    published = store.current(spark, f"{tmp_dir}/gold")
    strict = pipeline.LoadConfig(warehouse=tmp_dir, as_of=AS_OF, rules=GateRules())
    with pytest.raises(GateFailure):
        pipeline.publish_if_valid(spark, comp, est, strict)
    assert store.current(spark, f"{tmp_dir}/gold") == published
    assert pipeline.read_gold(spark, tmp_dir).count() == 3
    audit = spark.read.parquet(f"{tmp_dir}/audit")
    assert audit.select("run_id").distinct().count() == 2
    parse = audit.where("kind = 'parse' AND name = 'unparsable_capital'").select("value").distinct().collect()
    assert [r.value for r in parse] == [1.0]  # 'abc'; a null capital is not counted


def test_rebuild_marts_swaps_each_mart(spark, clean_raw, tmp_dir):
    comp, est = clean_raw
    g = gold.build_gold(comp, est, AS_OF)
    ref = spark.createDataFrame([(6201500, "Software")], "code bigint, description string")
    lk = pipeline.Lookups(ref, spark.createDataFrame([(7107, "Cidade")], "code bigint, description string"))
    broken = {"bad": lambda g, lk: g.select(F.col("no_such_column"))}
    registry = {**pipeline.default_marts(survival_min_count=1), **broken}
    done = pipeline.rebuild_marts(spark, g, lk, tmp_dir, registry)
    assert [(n, ok) for n, ok, _ in done if not ok] == [("bad", False)]
    assert pipeline.read_mart(spark, tmp_dir, "density_by_state").count() == 2


def test_bronze_ready(spark, clean_raw, tmp_dir):
    comp, est = clean_raw
    assert not pipeline.bronze_ready(spark, tmp_dir)
    pipeline.write_bronze(comp, est, tmp_dir)
    assert pipeline.bronze_ready(spark, tmp_dir)


def test_run_load_from_zipped_shards(spark, tmp_dir):
    """Whole load: zipped raw files -> Bronze -> gated Gold -> marts."""
    import os
    import zipfile

    src = f"{tmp_dir}/src"
    os.makedirs(src)
    companies = "1;ALPHA LTDA;2062;;1000,50;;\n2;BETA;2135;;0,00;;\n"
    est_cols = len(schemas.ESTABLISHMENTS_RAW_COLUMNS)

    def est_line(key, head, opened, cnae, city, uf, status, status_on):
        cells = [""] * est_cols
        for name, value in dict(
            cnpj_basico=key, matriz_filial=head, data_inicio_atividade=opened, cnae_fiscal=cnae,
            municipio=city, uf=uf, situacao_cadastral=status, data_situacao=status_on,
        ).items():
            cells[schemas.ESTABLISHMENTS_RAW_COLUMNS.index(name)] = value
        return ";".join(cells) + "\n"

    est = est_line("1", "1", "20100115", "6201500", "7107", "SP", "02", "20100115") + est_line(
        "2", "1", "19990101", "4711001", "6001", "RJ", "08", "20050101"
    ) + est_line("2", "2", "20000101", "4711001", "6001", "RJ", "02", "0").replace("RJ", "R\x00J")
    with zipfile.ZipFile(f"{src}/Empresas0.zip", "w") as z:
        z.writestr("E0.CSV", companies.encode("latin-1"))
    with zipfile.ZipFile(f"{src}/Estabelecimentos0.zip", "w") as z:
        z.writestr("S0.CSV", est.encode("latin-1"))
    cfg = pipeline.LoadConfig(warehouse=f"{tmp_dir}/wh", as_of=AS_OF, source_dir=src,
                              rules=GateRules(min_rows=1, max_decade_pct=100))
    ref = spark.createDataFrame([(6201500, "Software")], "code bigint, description string")
    lk = pipeline.Lookups(ref, spark.createDataFrame([(7107, "Cidade")], "code bigint, description string"))
    result = pipeline.run_load(spark, cfg, lk, pipeline.default_marts(survival_min_count=1))
    assert result.published and all(ok for _, ok, _ in result.marts)
    g = {r.company_id: r for r in pipeline.read_gold(spark, cfg.warehouse).collect()}
    assert set(g) == {"00000001", "00000002"} and g["00000002"].status_code == 8
    audit = spark.read.parquet(f"{cfg.warehouse}/audit")
    assert audit.where("kind = 'ingest_nul_removed'").agg(F.sum("value")).collect()[0][0] == 1
    assert pipeline.bronze_ready(spark, cfg.warehouse)
    survival = pipeline.read_mart(spark, cfg.warehouse, "survival_by_sector").collect()
    assert [(r.sector, r.total) for r in survival] == [("CNAE 4711001", 1)]


def test_a_failed_bronze_write_keeps_the_pair_before(spark, clean_raw, tmp_dir):
    from pyspark.sql import functions as F

    comp, est = clean_raw
    pipeline.write_bronze(comp, est, tmp_dir)
    before = pipeline.bronze_paths(spark, tmp_dir)
    broken = est.withColumn("uf", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        pipeline.write_bronze(comp.limit(1), broken, tmp_dir)
    assert pipeline.bronze_paths(spark, tmp_dir) == before and pipeline.bronze_ready(spark, tmp_dir)
    now = pipeline.read_bronze(spark, tmp_dir)
    assert (now[0].count(), now[1].count()) == (comp.count(), est.count())


def test_rejected_rows_are_stored_with_their_reason(spark, clean_raw, tmp_dir):
    from pyspark.sql import functions as F

    comp, est = clean_raw
    est = est.withColumn("data_inicio_atividade", F.when(F.col("cnpj_basico") == est.first().cnpj_basico, F.lit("20210231"))
                         .otherwise(F.col("data_inicio_atividade")))
    cfg = pipeline.LoadConfig(warehouse=tmp_dir, as_of="2026-02-28", rules=pipeline.GateRules(min_rows=0))
    result = pipeline.publish_if_valid(spark, comp, est, cfg, raise_on_failure=False)
    rows = spark.read.parquet(f"{tmp_dir}/quarantine/{result.run_id}").collect()
    assert rows and {(r.raw_opened_on, r.reason) for r in rows} == {("20210231", "impossible_date")}


def test_shuffles_are_sized_from_the_input(spark):
    from firmscope.session import size_shuffles

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        assert size_shuffles(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert size_shuffles(spark, 100 << 40) == 819_200 and spark.conf.get(key) == "819200"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_gates_are_measured_while_gold_is_written(spark, clean_raw, tmp_dir):
    """The same gate rows as from a scan of the files; Gold's dates and the quarantine are not read again."""
    comp, est = clean_raw
    cfg = pipeline.LoadConfig(warehouse=tmp_dir, as_of=AS_OF, rules=LENIENT)
    result = pipeline.publish_if_valid(spark, *pipeline.write_bronze(comp, est, tmp_dir), cfg)
    want = gates.gate_metrics(pipeline.read_gold(spark, tmp_dir), comp, AS_OF, rules=LENIENT)
    assert sorted(result.gate_rows) == sorted((r.gate, r.value, r.passed) for r in want.collect())
    audit = spark.read.parquet(f"{tmp_dir}/audit").where(F.col("run_id") == result.run_id)
    assert {(r.kind, r.name, r.value) for r in audit.where("kind <> 'gate'").collect()} == {
        ("quarantine", "impossible_date", 1.0), ("parse", "unparsable_capital", 1.0),
    }


def test_only_the_keys_of_written_gold_are_read_for_the_gates(spark, clean_raw, tmp_dir, monkeypatch):
    seen = []
    original = gates.Measured.gate_metrics
    monkeypatch.setattr(gates.Measured, "gate_metrics", lambda self, *a: seen.append(original(self, *a)) or seen[-1])
    comp, est = clean_raw
    cfg = pipeline.LoadConfig(warehouse=tmp_dir, as_of=AS_OF, rules=LENIENT)
    pipeline.publish_if_valid(spark, comp, est, cfg)
    plan = plan_text(seen[0])
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(scans) == 1 and scans[0].strip().endswith("struct<company_id:string>")


def test_rows_outside_the_counted_decades_are_taken_from_the_files(spark, tmp_dir):
    import datetime as dt
    from decimal import Decimal

    rows = [(f"{i:08d}", None, None, Decimal(0), dt.date(year, 5, 1), None, None, None, None, None) for i, year in enumerate([1850, 1851, 2001, 2001, 2001])]
    measured = gates.Measured(AS_OF)
    measured.observe(spark.createDataFrame(rows, schemas.GOLD)).write.parquet(f"{tmp_dir}/g")
    staged = spark.read.parquet(f"{tmp_dir}/g")
    got = {r.gate: r.value for r in measured.gate_metrics(staged, 5).collect()}
    assert got["date_range"] == 2 and got["decade_concentration"] == 60.0 and got["volume"] == 5


def test_an_empty_gold_fails_its_gates(spark, tmp_dir):
    measured = gates.Measured(AS_OF)
    measured.observe(spark.createDataFrame([], schemas.GOLD)).write.parquet(f"{tmp_dir}/g")
    got = {r.gate: r.passed for r in measured.gate_metrics(spark.read.schema(schemas.GOLD).parquet(f"{tmp_dir}/g"), 0, GateRules(min_rows=0)).collect()}
    assert not got["volume"] and not got["retention"] and not got["decade_concentration"] and got["duplicates"]
