"""Delimited dialect, zipped shard ingest, NUL scrubbing and CSV export."""

import datetime as dt
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.sources import delimited, export, zipshards

TWO = schemas.text_schema(["a", "b"])


def _write_zip(path, member, payload: bytes):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, payload)


def test_dialect_quotes_empty_and_null(spark, tmp_dir):
    path = f"{tmp_dir}/line.csv"
    with open(path, "wb") as f:
        f.write('"A ""x"" \\";"";;"v"\n'.encode("latin-1"))
    schema = schemas.text_schema(["c1", "c2", "c3", "c4"])
    row = delimited.scan_delimited(spark, path, schema).collect()[0]
    assert tuple(row) == ('A "x" \\', "", None, "v")


def test_short_or_long_rows_fail(spark, tmp_dir):
    path = f"{tmp_dir}/bad.csv"
    with open(path, "wb") as f:
        f.write(b"1;2\n3\n")
    with pytest.raises(Exception):
        delimited.scan_delimited(spark, path, TWO).collect()


def test_latin1_and_embedded_newline(spark, tmp_dir):
    path = f"{tmp_dir}/l1.csv"
    with open(path, "wb") as f:
        f.write('1;"São\nPaulo"\n2;"Açaí"\n'.encode("latin-1"))
    rows = [tuple(r) for r in delimited.scan_delimited(spark, path, TWO).collect()]
    assert rows == [("1", "São\nPaulo"), ("2", "Açaí")]


def test_zip_shards_cut_at_record_boundaries_and_strip_nul(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    lines = []
    for i in range(400):
        text = f'"line {i}\nsecond ""half"" {i}"' if i % 3 == 0 else f'"n\x00ame {i}"'
        lines.append(f"{i};{text}\n")
    _write_zip(f"{src}/Empresas0.zip", "K0.CSV", "".join(lines[:200]).encode("latin-1"))
    _write_zip(f"{src}/Empresas1.zip", "K1.CSV", "".join(lines[200:]).encode("latin-1"))
    rows, manifest = zipshards.ingest_zip_shards(spark, src, "Empresas*.zip", TWO, f"{tmp_dir}/out", part_bytes=1024)
    got = sorted((int(a), b) for a, b in rows.collect())
    want = []
    for i in range(400):
        want.append((i, f'line {i}\nsecond "half" {i}' if i % 3 == 0 else f"name {i}"))
    assert got == want
    m = manifest.collect()
    assert len({r.archive for r in m}) == 2 and len(m) > 4  # several parts per archive
    assert sum(r.nul_removed for r in m) == sum(1 for i in range(400) if i % 3)
    totals = zipshards.archive_running_total(manifest, rows).orderBy("shard").collect()
    assert totals[-1].running_total == 400


def test_no_archive_aborts(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        zipshards.find_archives(spark, tmp_dir, "Estabelecimentos*.zip")


def test_zip_round_trip_of_a_table(spark, tmp_dir):
    df = spark.createDataFrame(
        [("1", 'Com "aspas"', "", None), ("2", "Linha\nquebrada", "x", "y")],
        schemas.text_schema(["k", "a", "b", "c"]),
    )
    archives = zipshards.write_zip_shards(df, f"{tmp_dir}/zips", "Empresas", 2)
    assert len(archives) == 2
    rows, _ = zipshards.ingest_zip_shards(
        spark, f"{tmp_dir}/zips", "Empresas*.zip", df.schema, f"{tmp_dir}/expanded", part_bytes=16
    )
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect()))


def test_reference_loading(spark, tmp_dir):
    path = f"{tmp_dir}/ref.csv"
    with open(path, "wb") as f:
        f.write("0111301;  Cultivo de arroz \nX12;Bad code\n4711;\n".encode("latin-1"))
    out = f"{tmp_dir}/ref_table"
    rows = delimited.load_reference(spark, path, out).orderBy("description").collect()
    assert [(r.code, r.description) for r in rows] == [(4711, None), (None, "Bad code"), (111301, "Cultivo de arroz")]


def test_export_csv_with_bom_and_separator(spark, tmp_dir):
    df = spark.createDataFrame([("SP", 3, 12.5), ("RJ", 1, None)], "region string, n long, pct double")
    path = export.export_csv(df, tmp_dir, "comparison_kpis", on=dt.date(2026, 2, 28))
    assert path.endswith("comparison_kpis_20260228.csv")
    raw = open(path.replace("file:", ""), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfregion;n;pct\n")
    back = export.read_export(spark, path)
    assert back.columns == ["region", "n", "pct"]
    assert sorted(tuple(r) for r in back.collect()) == [("RJ", "1", None), ("SP", "3", "12.5")]


def test_scrub_columns_counts_removed(spark):
    df = spark.createDataFrame([("a\x00b", "c"), ("d", "\x00\x00")], "x string, y string")
    cleaned, removed = delimited.scrub_columns(df)
    assert [tuple(r) for r in cleaned.collect()] == [("ab", "c"), ("d", "")]
    assert df.agg(removed).collect()[0][0] == 3


def test_shard_running_total(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(10)], "s int")
    rows = delimited.shard_running_total(df, "s").orderBy("shard").collect()
    assert [(r.shard, r.rows, r.running_total) for r in rows] == [(0, 4, 4), (1, 3, 7), (2, 3, 10)]


def test_file_uris_are_local_paths(spark, tmp_dir):
    from firmscope.sources.zipshards import _fs_and_path

    for uri in (f"file:{tmp_dir}", f"file://{tmp_dir}", tmp_dir):
        _, path = _fs_and_path(uri)
        assert path == tmp_dir
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    _write_zip(f"{src}/Empresas0.zip", "A.CSV", b'1;"x"\n')
    rows, _ = zipshards.ingest_zip_shards(spark, f"file:{src}", "Empresas*.zip", TWO, f"file:{tmp_dir}/out")
    assert [tuple(r) for r in rows.collect()] == [("1", "x")]


def test_every_member_of_an_archive_is_read(spark, tmp_dir):
    src = f"{tmp_dir}/two"
    os.makedirs(src)
    with zipfile.ZipFile(f"{src}/Empresas0.zip", "w") as z:
        z.writestr("A.CSV", b'1;"x"\n')
        z.writestr("folder/", b"")
        z.writestr("folder/B.CSV", b'2;"y"\n3;"z"\n')
    rows, manifest = zipshards.ingest_zip_shards(spark, src, "Empresas*.zip", TWO, f"{tmp_dir}/two-out")
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]
    assert {r.member for r in manifest.collect()} == {"A.CSV", "folder/B.CSV"}


def test_a_second_expansion_does_not_disturb_the_first(spark, tmp_dir):
    """Each attempt writes a folder of its own; only folders in the committed manifest are read."""
    src, out = f"{tmp_dir}/again", f"{tmp_dir}/again-out"
    os.makedirs(src)
    _write_zip(f"{src}/Empresas0.zip", "A.CSV", b'1;"x"\n2;"y"\n')
    lost = zipshards.expand_member(f"{src}/Empresas0.zip", "A.CSV", out, 8)  # an attempt that was not committed
    rows, manifest = zipshards.ingest_zip_shards(spark, src, "Empresas*.zip", TWO, out, part_bytes=8)
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x"), ("2", "y")]
    assert not {r.folder for r in manifest.collect()} & {r[2] for r in lost}


def test_archives_keep_scheme_and_host(spark, monkeypatch):
    from pyarrow import fs as pafs

    class Store:
        def get_file_info(self, selector):
            return [pafs.FileInfo("/data/Empresas1.zip", pafs.FileType.File), pafs.FileInfo("/data/other", pafs.FileType.File)]

    monkeypatch.setattr(zipshards, "_fs_and_path", lambda uri: (Store(), "/data"))
    assert zipshards.find_archives(spark, "hdfs://host:8020/data/", "Empresas*.zip") == ["hdfs://host:8020/data/Empresas1.zip"]


def test_exports_are_whole_or_refused(spark, tmp_dir):
    df = spark.range(100_001).selectExpr("id", "id * 2 AS twice")
    with pytest.raises(ValueError):
        export.export_csv(df, tmp_dir, "big", dt.date(2026, 2, 28))
    path = export.export_parts(df.repartition(4), tmp_dir, "big", dt.date(2026, 2, 28))
    back = spark.read.option("sep", ";").option("header", "true").csv(path)
    assert back.count() == 100_001 and back.agg({"twice": "max"}).first()[0] is not None
    small = spark.range(2).toDF("n")
    first = export.export_csv(small, tmp_dir, "small", dt.date(2026, 2, 28))
    assert export.export_csv(spark.range(3).toDF("n"), tmp_dir, "small", dt.date(2026, 2, 28)) == first
    assert export.read_export(spark, first).count() == 3


def test_queries_run_from_any_folder(tmp_dir):
    """The package reaches the Python workers wherever the driver was started."""
    import subprocess
    import sys

    program = (
        "import sys; sys.path.insert(0, %r); from firmscope.session import build_session; "
        "from firmscope.plans import catalog; s = build_session('local[2]', shuffle_partitions=2); "
        "print('rows', catalog.queries()['ingest_zip_shards'](s, '/root/testdata/sf0.001').count())"
    ) % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", program], cwd="/tmp", env=env, capture_output=True, text=True, timeout=200)
    assert "rows " in got.stdout and int(got.stdout.split("rows ")[1]) > 0, got.stderr[-800:]


# --- splittable scan ------------------------------------------------------------


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of some hundred bytes, so that records span them."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


THREE = schemas.text_schema(["a", "b", "c"])


def _random_file(rng, records: int) -> bytes:
    def cell() -> bytes:
        kind = rng.random()
        if kind < 0.3:
            return rng.choice([b'""', b"", b"1,5", "São".encode("latin-1"), b" x "])
        pieces = [b"a", b"\n", b'""', b";", "ç".encode("latin-1"), b"\\", b" ", b"\n\n"]
        return b'"' + b"".join(rng.choices(pieces, k=rng.choice([0, 3, 12, 900 if kind < 0.32 else 5]))) + b'"'

    rows = [b"%d;%s;%s\n" % (i, cell(), cell()) + (b"\n" if rng.random() < 0.05 else b"") for i in range(records)]
    return b"".join(rows) + rng.choice([b"", b'z;y;"no line end"'])


def test_splittable_scan_equals_the_whole_file_scan(spark, tmp_dir, small_ranges):
    rng = random.Random(11)
    for k in range(3):
        with open(f"{tmp_dir}/f{k}.csv", "wb") as f:
            f.write(_random_file(rng, 150))
    open(f"{tmp_dir}/empty.csv", "w").close()
    want = sorted(map(str, delimited.scan_delimited(spark, tmp_dir, THREE).collect()))
    got = delimited.scan_splittable(spark, tmp_dir, THREE)
    assert got.schema == THREE and sorted(map(str, got.collect())) == want
    ranges = spark.read.text(tmp_dir).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert ranges > 30  # of four files
    assert delimited.scan_splittable(spark, f"{tmp_dir}/empty.csv", THREE).count() == 0


def test_splittable_scan_with_carriage_returns(spark, tmp_dir, small_ranges):
    with open(f"{tmp_dir}/crlf.csv", "wb") as f:
        f.write(b'1;"a\r\nb"\r\n\r\n2;c\r\n' * 100)
    rows = [tuple(r) for r in delimited.scan_splittable(spark, f"{tmp_dir}/crlf.csv", TWO).collect()]
    assert sorted(rows) == sorted([("1", "a\r\nb"), ("2", "c")] * 100)


@pytest.mark.parametrize("text", [b"1;2\n3\n", b"1;2;3\n", b'1;"never closed\n' * 3])
def test_splittable_scan_fails_on_damage(spark, tmp_dir, text):
    with open(f"{tmp_dir}/bad.csv", "wb") as f:
        f.write(text)
    with pytest.raises(Exception):
        delimited.scan_splittable(spark, f"{tmp_dir}/bad.csv", TWO).collect()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_plain_files_stay_in_their_task(spark, tmp_dir, small_ranges):
    with open(f"{tmp_dir}/plain.csv", "wb") as f:
        f.write(b'1;"a ""b"""\r\n2;\n\r\n\n3;"S\xe3o;"\n' * 50)
    got = delimited.scan_splittable(spark, f"{tmp_dir}/plain.csv", TWO)
    assert not any(word in _plan(got) for word in ("MapInArrow", "Join", "Aggregate", "Window"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("1", 'a "b"'), ("2", None), ("3", "São;")] * 50, key=str)


def test_only_parts_of_records_across_ranges_are_shuffled(spark, tmp_dir, small_ranges):
    lines = [b'%d;"%s"\n' % (i, b"x\n" * (i % 3) + b"\n\n" * 400 * (i == 50)) for i in range(100)]
    with open(f"{tmp_dir}/f.csv", "wb") as f:
        f.write(b"".join(lines))
    got = delimited.scan_splittable(spark, f"{tmp_dir}/f.csv", TWO)
    want = {(str(i), "x\n" * (i % 3) + "\n\n" * 400 * (i == 50)) for i in range(100)}
    assert {tuple(r) for r in got.collect()} == want
    assert "lines" not in _plan(got) and {tuple(r) for r in got.filter("a IN ('1', '50')").collect()} == {x for x in want if x[0] in ("1", "50")}
    batch = {"number": [0] * 4 + [1] * 3, "file_no": [0] * 7, "before": [0] * 4 + [3] * 3, "odd": [3] * 4 + [1] * 3}
    table = pa.table(batch).append_column("value", pa.array([b"0;z", b'1;"a', b'b"', b'2;"c', b"d", b'e"', b"3;f"], pa.binary()))
    whole, parts = ([r for b in delimited._records(iter(table.to_batches()), parts) for r in b.to_pylist()] for parts in (False, True))
    assert [r["value"] for r in whole] == [b"0;z", b'1;"a\nb"', b"3;f"]
    assert [tuple(r.values()) for r in parts] == [(0, 1, 0, b'2;"c'), (0, 1, 1, b'd\ne"')]


def test_a_file_that_changes_after_the_first_pass_fails(spark, tmp_dir):
    path = f"{tmp_dir}/f.csv"
    for before, after in ((b"1;22\n", b'1;"2\n'), (b'1;"2\n"\n', b"1;2222\n")):
        with open(path, "wb") as f:
            f.write(before)
        got = delimited.scan_splittable(spark, path, TWO)
        with open(path, "wb") as f:
            f.write(after)
        with pytest.raises(Exception, match="changed during the scan"):
            got.collect()
