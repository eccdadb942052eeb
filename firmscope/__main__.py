"""Command line for the registry jobs.

    python -m firmscope load-references --source DIR --warehouse DIR
    python -m firmscope load --source DIR --warehouse DIR --as-of 2026-02-28 [--reuse-bronze]
    python -m firmscope refresh-marts --warehouse DIR
    python -m firmscope metrics --warehouse DIR --as-of 2026-02-28
    python -m firmscope benchmark --warehouse DIR --as-of 2026-02-28 [--runs 5] [--query Q5] [--explain]
    python -m firmscope inspect --warehouse DIR --table gold|<mart>|ref/<lookup> [--rows 5]
    python -m firmscope compare --warehouse DIR --regions SP RJ [--region-column state] [--export DIR]
    python -m firmscope listing --warehouse DIR [--sector S] [--city C] [--top 25] [--export DIR]
    python -m firmscope options --warehouse DIR [--region-column state] [--cities 100]
    python -m firmscope segments --warehouse DIR --favourites '[{"nome": "...", "setor": "Todos", "cidade": "..."}]'

Only summaries are printed; every table stays in the warehouse (a shared
folder on a cluster).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from firmscope import schemas
from firmscope.operators.gates import GateFailure, GateRules
from firmscope.plans import pipeline, store
from firmscope.session import build_session, shared_dir

# Archive name of each lookup and the table it becomes.
REFERENCE_ARCHIVES = {"Cnaes.zip": "activity", "Municipios.zip": "city", "Naturezas.zip": "legal_nature"}


def reference_path(warehouse: str, name: str) -> str:
    return f"{warehouse}/ref/{name}"


def load_references(spark, source: str, warehouse: str) -> dict[str, int]:
    """Each lookup archive -> (code, description) table, replaced in place."""
    import uuid

    from firmscope.sources import delimited, zipshards

    counts = {}
    for archive, name in REFERENCE_ARCHIVES.items():
        try:
            raw, _ = zipshards.ingest_zip_shards(
                spark, source, archive, schemas.REFERENCE_RAW, f"{warehouse}/_expanded/ref-{uuid.uuid4().hex}"
            )
        except FileNotFoundError:
            print(f"[warning] {archive} not found in {source}", file=sys.stderr)
            continue
        out = reference_path(warehouse, name)
        version = store.new_version_path(spark, out)
        delimited.reference_from_raw(raw).write.mode("overwrite").parquet(version)
        store.publish(spark, out, version)
        counts[name] = spark.read.parquet(version).count()
    return counts


def lookups(spark, warehouse: str) -> pipeline.Lookups:
    def read(name):
        return store.read_current(spark, reference_path(warehouse, name))

    legal = store.current(spark, reference_path(warehouse, "legal_nature"))
    return pipeline.Lookups(read("activity"), read("city"), spark.read.parquet(legal) if legal else None)


def metrics_report(spark, warehouse: str, as_of: str, state: str = "SP") -> dict:
    from firmscope.operators import metrics

    gold = pipeline.read_gold(spark, warehouse)
    reports = {
        "universe": metrics.universe_stats(gold),
        "age_active": metrics.age_active(gold, as_of),
        "age_all": metrics.age_all(gold, as_of),
        "zero_capital": metrics.zero_capital_share(gold),
        "retail_division_47": metrics.sector_prefix_share(gold, "47"),
        "status": metrics.status_distribution(gold).orderBy("companies", ascending=False),
        "survival": metrics.survival_global(gold),
        "survival_discards": metrics.survival_discards(gold),
        "state_openings": metrics.state_openings_by_year(gold, state).orderBy("year"),
        "decades": metrics.decade_distribution(gold).orderBy("decade"),
    }
    return {k: [r.asDict() for r in df.collect()] for k, df in reports.items()}


def export_day(as_of: str | None) -> dt.date:
    return dt.date.fromisoformat(as_of) if as_of else dt.date.today()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="firmscope")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("load-references")
    r.add_argument("--source", required=True)
    r.add_argument("--warehouse", required=True)
    ld = sub.add_parser("load")
    ld.add_argument("--source", required=True)
    ld.add_argument("--warehouse", required=True)
    ld.add_argument("--as-of", required=True)
    ld.add_argument("--reuse-bronze", action="store_true")
    ld.add_argument("--min-rows", type=int, default=GateRules().min_rows)
    rm = sub.add_parser("refresh-marts")
    rm.add_argument("--warehouse", required=True)
    m = sub.add_parser("metrics")
    m.add_argument("--warehouse", required=True)
    m.add_argument("--as-of", required=True)
    m.add_argument("--state", default="SP", help="state of the openings per year")
    b = sub.add_parser("benchmark")
    b.add_argument("--warehouse", required=True)
    b.add_argument("--as-of", required=True)
    b.add_argument("--runs", type=int, default=5)
    b.add_argument("--query", default=None, help="run one query only, e.g. Q5")
    b.add_argument("--explain", action="store_true")
    ins = sub.add_parser("inspect", help="columns, types and a few ordered rows of gold, a mart or a lookup")
    ins.add_argument("--warehouse", required=True)
    ins.add_argument("--table", required=True, help="gold, a mart name, or ref/activity|city|legal_nature")
    ins.add_argument("--rows", type=int, default=5)
    cmp_ = sub.add_parser("compare", help="side-by-side comparison of 2-4 regions or cities")
    cmp_.add_argument("--warehouse", required=True)
    grp = cmp_.add_mutually_exclusive_group(required=True)
    grp.add_argument("--regions", nargs="+")
    grp.add_argument("--cities", nargs="+", type=int)
    cmp_.add_argument("--region-column", default="state", help="a Gold column or city_prefix2")
    cmp_.add_argument("--top-n", type=int, default=8)
    cmp_.add_argument("--year-from", type=int, default=2000)
    cmp_.add_argument("--as-of", default=None, help="date of the data, for the names of exported files (default: today)")
    cmp_.add_argument("--export", default=None, help="folder for the dated KPI and sector CSV files")
    lst = sub.add_parser("listing", help="filtered listing: KPIs, openings by year, capital by city, ranking")
    lst.add_argument("--warehouse", required=True)
    lst.add_argument("--sector", default=None, help="activity description ('Todos' = any)")
    lst.add_argument("--city", default=None, help="city name ('Todas' = any)")
    lst.add_argument("--top", type=int, default=25, choices=[10, 25, 50, 100])
    lst.add_argument("--as-of", default=None, help="date of the data, for the names of exported files (default: today)")
    lst.add_argument("--preview", type=int, default=0, help="show the first rows by opening date")
    lst.add_argument("--export", default=None, help="folder for the dated CSV parts of the whole filtered listing")
    seg = sub.add_parser("segments", help="KPIs of every saved favourite")
    seg.add_argument("--warehouse", required=True)
    seg.add_argument("--favourites", required=True, help='JSON list of {"nome", "setor", "cidade"}')
    opt = sub.add_parser("options", help="regions with their most common city, and the largest cities, to pick from")
    opt.add_argument("--warehouse", required=True)
    opt.add_argument("--region-column", default="state", help="a Gold column or city_prefix2")
    opt.add_argument("--cities", type=int, default=100)
    args = p.parse_args(argv)

    spark = build_session()
    shared_dir(spark)
    if args.cmd == "load-references":
        print(json.dumps(load_references(spark, args.source, args.warehouse)))
        return 0
    if args.cmd == "load":
        cfg = pipeline.LoadConfig(
            warehouse=args.warehouse,
            as_of=args.as_of,
            source_dir=args.source,
            reuse_bronze=args.reuse_bronze,
            rules=GateRules(min_rows=args.min_rows),
        )
        try:
            result = pipeline.run_load(spark, cfg, lookups(spark, args.warehouse))
        except GateFailure as exc:
            print(json.dumps({"published": False, "failed": exc.failed, "gates": exc.metrics}, default=str))
            return 1
        print(json.dumps({"published": True, "gold": result.gold_path, "gates": result.gate_rows,
                          "marts": result.marts}, default=str))
        return 0
    if args.cmd == "refresh-marts":
        done = pipeline.rebuild_marts(spark, pipeline.read_gold(spark, args.warehouse), lookups(spark, args.warehouse),
                                      args.warehouse)
        print(json.dumps(done, default=str))
        return 0 if all(ok for _, ok, _ in done) else 1
    if args.cmd == "benchmark":
        from firmscope.plans import benchmark

        qs = benchmark.dashboard_queries(spark, args.warehouse, lookups(spark, args.warehouse), args.as_of)
        if args.query:
            if args.query.upper() not in qs:
                print(f"unknown query {args.query}; known: {', '.join(qs)}", file=sys.stderr)
                return 1
            qs = {args.query.upper(): qs[args.query.upper()]}
        print(json.dumps(benchmark.time_queries(qs, args.runs, args.explain), indent=1))
        return 0
    if args.cmd == "inspect":
        from firmscope.operators import profiling

        if args.table == "gold":
            df = pipeline.read_gold(spark, args.warehouse)
        elif args.table.startswith("ref/"):
            df = store.read_current(spark, f"{args.warehouse}/{args.table}")
        else:
            df = pipeline.read_mart(spark, args.warehouse, args.table)
        schema = [r.asDict() for r in profiling.describe_schema(spark, df).collect()]
        rows = [r.asDict() for r in profiling.preview_rows(df, args.rows).collect()]
        print(json.dumps({"columns": schema, "rows": rows}, default=str, indent=1))
        return 0
    if args.cmd == "compare":
        from firmscope.operators import regions
        from firmscope.sources import export

        gold = pipeline.read_gold(spark, args.warehouse)
        try:
            if args.regions:
                counts = pipeline.read_mart(spark, args.warehouse, "city_year_counts")
                result = regions.compare_regions(gold, counts, regions.check_selection(args.regions), args.region_column,
                                                 args.top_n, args.year_from)
            else:
                growth = pipeline.read_mart(spark, args.warehouse, "growth_by_city")
                result = regions.compare_cities(gold, growth, lookups(spark, args.warehouse).city,
                                                regions.check_selection(args.cities), args.top_n, args.year_from)
        except ValueError as exc:
            print(str(exc), file=sys.stderr)
            return 1
        out = {name: [r.asDict() for r in getattr(result, name).collect()]
               for name in ("kpis", "sectors", "growth", "matrix")}
        label = "region_label" if args.regions else "city_name"
        out["bars"] = [r[label] for r in regions.bar_order(result.kpis, label=label).collect()]  # ascending, as they are drawn
        if args.export:
            day = export_day(args.as_of)
            out["files"] = [export.export_csv(result.kpis, args.export, "comparison_kpis", day),
                            export.export_csv(result.sectors, args.export, "comparison_sectors", day)]
        print(json.dumps(out, default=str, indent=1))
        return 0
    if args.cmd == "listing":
        from firmscope.operators import listing
        from firmscope.sources import export

        lk = lookups(spark, args.warehouse)
        filtered = listing.companies_filtered(pipeline.read_gold(spark, args.warehouse), lk.activity, lk.city,
                                              args.sector, args.city)
        out = {
            "kpis": [r.asDict() for r in listing.headline_kpis(filtered).collect()],
            "openings_by_year": [r.asDict() for r in listing.openings_by_year(filtered).orderBy("year").collect()],
            "capital_by_city_top10": [r.asDict() for r in listing.capital_by_city_top(filtered, 10).collect()],
            "ranking": [r.asDict() for r in listing.top_companies_filtered(filtered, args.top).collect()],
        }
        if args.preview:
            rows = listing.companies_preview(pipeline.read_gold(spark, args.warehouse), lk.activity, lk.city, args.preview,
                                             args.sector, args.city)
            out["preview"] = [r.asDict() for r in rows.collect()]
        if args.export:
            out["files"] = export.export_parts(filtered, args.export, "companies_listing", export_day(args.as_of))
        print(json.dumps(out, default=str, indent=1))
        return 0
    if args.cmd == "options":
        from firmscope.operators import regions

        gold, lk = pipeline.read_gold(spark, args.warehouse), lookups(spark, args.warehouse)
        top = regions.region_display_label(regions.region_top_city(gold, lk.city, args.region_column)).orderBy("region")
        cities = regions.top_cities(gold, lk.city, args.cities)
        print(json.dumps({"regions": [r.asDict() for r in top.collect()], "cities": [r.asDict() for r in cities.collect()]},
                         default=str, indent=1))
        return 0
    if args.cmd == "segments":
        from firmscope.operators import listing

        lk = lookups(spark, args.warehouse)
        segs = listing.segments_from_json(spark, args.favourites)
        kpis = listing.segment_kpis(pipeline.read_gold(spark, args.warehouse), lk.activity, lk.city, segs)
        print(json.dumps([r.asDict() for r in kpis.orderBy("position").collect()], default=str, indent=1))
        return 0
    if args.cmd == "metrics":
        print(json.dumps(metrics_report(spark, args.warehouse, args.as_of, args.state), default=str, indent=1))
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
