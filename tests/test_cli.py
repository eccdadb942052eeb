"""The command line: lookups, gated load, mart refresh and metrics."""

import json
import os
import zipfile

from firmscope import __main__ as cli
from firmscope import schemas


def _zip(path, member, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(member, text.encode("latin-1"))


def _est(key, head, opened, cnae, city, uf, status, status_on):
    cells = [""] * len(schemas.ESTABLISHMENTS_RAW_COLUMNS)
    for name, value in dict(
        cnpj_basico=key, matriz_filial=head, data_inicio_atividade=opened, cnae_fiscal=cnae,
        municipio=city, uf=uf, situacao_cadastral=status, data_situacao=status_on,
    ).items():
        cells[schemas.ESTABLISHMENTS_RAW_COLUMNS.index(name)] = value
    return ";".join(f'"{c}"' if c else "" for c in cells) + "\n"


def test_command_line_jobs(spark, tmp_dir, capsys):
    src, wh = f"{tmp_dir}/src", f"{tmp_dir}/wh"
    os.makedirs(src)
    _zip(f"{src}/Cnaes.zip", "F.K03200$Z.D60214.CNAECSV", '"4711302";"Comércio varejista"\n"6201501";"Software"\n')
    _zip(f"{src}/Municipios.zip", "M.CSV", '"7107";"SAO PAULO"\n"6001";"RIO DE JANEIRO"\n')
    _zip(f"{src}/Naturezas.zip", "N.CSV", '"2062";"Sociedade Limitada"\n')
    _zip(f"{src}/Empresas0.zip", "E.CSV", '"00000001";"ALFA LTDA";"2062";"49";"1000,00";"01";""\n'
                                            '"00000002";"BETA";"2062";"49";"0,00";"01";""\n')
    _zip(f"{src}/Estabelecimentos0.zip", "S.CSV",
         _est("00000001", "1", "20100115", "6201501", "7107", "SP", "02", "20100115")
         + _est("00000002", "1", "19990101", "4711302", "6001", "RJ", "08", "20050101"))

    assert cli.main(["load-references", "--source", src, "--warehouse", wh]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"activity": 2, "city": 2, "legal_nature": 1}

    assert cli.main(["load", "--source", src, "--warehouse", wh, "--as-of", "2026-02-28", "--min-rows", "1"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["published"] and all(ok for _, ok, _ in out["marts"])

    assert cli.main(["refresh-marts", "--warehouse", wh]) == 0
    capsys.readouterr()
    assert cli.main(["metrics", "--warehouse", wh, "--as-of", "2026-02-28"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["universe"][0]["companies"] == 2
    assert report["survival"][0]["closed"] == 1
    assert report["zero_capital"][0]["companies"] == 1

    assert cli.main(["benchmark", "--warehouse", wh, "--as-of", "2026-02-28", "--runs", "2"]) == 0
    timings = json.loads(capsys.readouterr().out)
    assert [t["id"] for t in timings] == [f"Q{i}" for i in range(1, 11)]
    assert cli.main(["benchmark", "--warehouse", wh, "--as-of", "2026-02-28", "--runs", "1", "--query", "q7",
                     "--explain"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert one[0]["rows"] == 1 and "Scan parquet" in one[0]["plan"]

    assert cli.main(["inspect", "--warehouse", wh, "--table", "growth_by_city", "--rows", "1"]) == 0
    info = json.loads(capsys.readouterr().out)
    assert [c["column_name"] for c in info["columns"]] == ["year", "city_code", "city_name", "total"]
    assert len(info["rows"]) == 1
    assert cli.main(["inspect", "--warehouse", wh, "--table", "ref/city"]) == 0
    assert len(json.loads(capsys.readouterr().out)["rows"]) == 2

    assert cli.main(["compare", "--warehouse", wh, "--regions", "SP", "RJ", "--year-from", "1990",
                     "--export", f"{tmp_dir}/exp"]) == 0
    cmp_out = json.loads(capsys.readouterr().out)
    assert {r["region"] for r in cmp_out["kpis"]} == {"SP", "RJ"} and len(cmp_out["bars"]) <= 2
    assert sum(r["openings"] for r in cmp_out["growth"]) == 2
    assert len(cmp_out["files"]) == 2 and all(f.endswith(".csv") for f in cmp_out["files"])
    assert cli.main(["compare", "--warehouse", wh, "--regions", "SP"]) == 1
    capsys.readouterr()

    assert cli.main(["listing", "--warehouse", wh, "--sector", "Software", "--top", "10", "--export", f"{tmp_dir}/exp"]) == 0
    lst = json.loads(capsys.readouterr().out)
    assert lst["kpis"][0]["companies"] == 1 and [r["legal_name"] for r in lst["ranking"]] == ["ALFA LTDA"]
    exported = spark.read.option("sep", ";").option("header", "true").csv(lst["files"])
    assert [r.legal_name for r in exported.collect()] == ["ALFA LTDA"]
    assert cli.main(["options", "--warehouse", wh]) == 0
    options = json.loads(capsys.readouterr().out)
    assert {r["region"] for r in options["regions"]} == {"SP", "RJ"} and options["regions"][0]["label"].startswith("Grupo ")
    favs = json.dumps([{"nome": "tudo", "setor": "Todos", "cidade": "Todas"},
                       {"nome": "rio", "setor": "Todos", "cidade": "RIO DE JANEIRO"}])
    assert cli.main(["segments", "--warehouse", wh, "--favourites", favs]) == 0
    segs = {r["segment"]: r["companies"] for r in json.loads(capsys.readouterr().out)}
    assert segs == {"tudo": 1, "rio": 0}  # only positive capital is listed

    # a stricter volume gate aborts the next load and keeps the published Gold
    assert cli.main(["load", "--source", src, "--warehouse", wh, "--as-of", "2026-02-28", "--reuse-bronze"]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["failed"] == ["volume"]
