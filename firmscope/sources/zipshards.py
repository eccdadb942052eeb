"""Ingest of zipped registry shards.

Each member of each archive is expanded by one Spark task (``mapInPandas`` over
the list of members): it is streamed in 1 MiB blocks, NUL bytes are
removed and counted on the fly, and the text is cut into CSV parts of about
``part_bytes`` at *record* boundaries (a newline outside quotes), so the
multi-line CSV scan that follows gets one task per part instead of one per
archive.  Nothing is uncompressed on the driver; parts are written to the
shared folder through the Arrow filesystem layer (local, HDFS or object store).
"""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.session import ship_package
from firmscope.sources.delimited import scan_delimited

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("part_index", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("nul_removed", T.LongType()),
    ]
)

BLOCK = 1 << 20
NUL = b"\x00"
QUOTE = b'"'
NEWLINE = b"\n"


def _fs_and_path(uri: str):
    """Arrow filesystem and path for a URI; ``file:`` URIs (one or three
    slashes, as Hadoop prints them) and bare paths are local."""
    from pyarrow import fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _record_cut(block: bytes, parity: int, start: int) -> int:
    """Offset just after the first newline at or after ``start`` that lies
    outside quotes, or -1.  ``parity`` is the quote parity before ``block``."""
    parity = (parity + block.count(QUOTE, 0, start)) % 2
    pos = start
    while True:
        nl = block.find(NEWLINE, pos)
        if nl < 0:
            return -1
        parity = (parity + block.count(QUOTE, pos, nl)) % 2
        if parity == 0:
            return nl + 1
        pos = nl + 1


def member_names(archive: str) -> list[str]:
    """The files in an archive, from its directory."""
    fs, path = _fs_and_path(archive)
    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        return [i.filename for i in z.infolist() if not i.is_dir()]


def expand_member(archive: str, member: str, dest_dir: str, part_bytes: int) -> list[tuple]:
    """Stream one member of ``archive`` into CSV parts in a folder of this task attempt below ``dest_dir``.

    The committed manifest names the folder of the attempt that won; parts of
    other attempts are never read.
    """
    fs, path = _fs_and_path(archive)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    folder = f"{dest_dir.rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    dfs, dpath = _fs_and_path(folder)
    dfs.create_dir(dpath, recursive=True)
    rows: list[tuple] = []
    with fs.open_input_file(path) as raw:
        with zipfile.ZipFile(raw) as z:
            with z.open(member) as src:
                idx, parity, size, nul = 0, 0, 0, 0

                def open_part():
                    return dfs.open_output_stream(f"{dpath}/{stem}-{idx:05d}.csv")

                out = open_part()

                def close_part():
                    out.close()
                    rows.append((archive, member, folder, idx, size, nul))

                while True:
                    block = src.read(BLOCK)
                    if not block:
                        break
                    removed = block.count(NUL)
                    if removed:
                        block = block.replace(NUL, b"")
                        nul += removed
                    while block:
                        room = part_bytes - size
                        if len(block) <= room:
                            out.write(block)
                            size += len(block)
                            parity = (parity + block.count(QUOTE)) % 2
                            break
                        cut = _record_cut(block, parity, max(room, 0))
                        if cut < 0:
                            out.write(block)
                            size += len(block)
                            parity = (parity + block.count(QUOTE)) % 2
                            break
                        head, block = block[:cut], block[cut:]
                        out.write(head)
                        size += len(head)
                        parity = 0
                        close_part()
                        idx, size, nul = idx + 1, 0, 0
                        out = open_part()
                close_part()
    return [r for r in rows if r[4] > 0 or r[3] == 0]


def find_archives(spark: SparkSession, source_dir: str, pattern: str) -> list[str]:
    """Archives in ``source_dir`` matching a glob pattern, sorted by name.

    Raises when there is none, so a missing shard set aborts the load.
    """
    fs, path = _fs_and_path(source_dir)
    from pyarrow import fs as pafs

    infos = fs.get_file_info(pafs.FileSelector(path, recursive=False))
    names = sorted(i.path for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, pattern))
    if "://" in source_dir and not source_dir.startswith("file:"):
        names = [f"{source_dir.rstrip('/')}/{n.rsplit('/', 1)[-1]}" for n in names]  # scheme and host stay
    if not names:
        raise FileNotFoundError(f"no archive matches {pattern} in {source_dir}")
    return names


def expand_archives(
    spark: SparkSession, archives: Sequence[str], dest_dir: str, part_bytes: int = 128 << 20
) -> DataFrame:
    """Expand every member of every archive on the executors, one task each;
    returns the manifest of written parts."""
    ship_package(spark)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, m) for a in pdf["archive"] for m in member_names(a)]
            yield pd.DataFrame(found, columns=["archive", "member"])

    listing = spark.createDataFrame([(a,) for a in archives], "archive string")
    found = listing.repartition(max(len(archives), 1)).mapInPandas(members, "archive string, member string")
    jobs = [(i, r.archive, r.member) for i, r in enumerate(found.orderBy("archive", "member").collect())]  # names only

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for archive, member in zip(pdf["archive"], pdf["member"]):
                out.extend(expand_member(archive, member, dest_dir, part_bytes))
            yield pd.DataFrame(out, columns=[f.name for f in MANIFEST_SCHEMA.fields])

    tasks = spark.createDataFrame(jobs, "idx int, archive string, member string")
    return tasks.repartitionByRange(max(len(jobs), 1), "idx").mapInPandas(run, MANIFEST_SCHEMA)


def ingest_zip_shards(
    spark: SparkSession,
    source_dir: str,
    pattern: str,
    schema: T.StructType,
    dest_dir: str,
    part_bytes: int = 128 << 20,
) -> tuple[DataFrame, DataFrame]:
    """Raw table from every archive matching ``pattern`` (S1 + S2 + S5).

    Returns ``(rows, manifest)``; the manifest (archive, part, bytes, NULs
    removed) is written next to the parts and read back, so the expansion runs
    exactly once.
    """
    archives = find_archives(spark, source_dir, pattern)
    manifest_path = f"{dest_dir}/_manifest"
    expand_archives(spark, archives, dest_dir, part_bytes).write.mode("overwrite").parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path)
    # One folder per archive member, of the attempt that won: as many names as members, not as parts.
    folders = [r[0] for r in manifest.select("folder").distinct().orderBy("folder").collect()]
    rows = scan_delimited(spark, folders, schema)
    return rows, manifest


def archive_running_total(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per archive in name order with the running total.

    Rows are tagged with their folder; the manifest maps folders to archives.
    """
    from firmscope.sources.delimited import shard_running_total

    parent = r"([^/]+)/[^/]+$"
    tagged = rows.select(F.regexp_extract(F.input_file_name(), parent, 1).alias("_folder"))
    folders = manifest.select(F.regexp_extract(F.col("folder"), r"[^/]+$", 0).alias("_folder"), "archive").distinct()
    return shard_running_total(tagged.join(folders, "_folder"), "archive")


# --- fixture side: write zipped shards from a DataFrame -----------------------

REGISTRY_CSV_WRITE = {
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "encoding": "ISO-8859-1",
    "header": "false",
    "nullValue": "",
    "emptyValue": '""',
}


def write_zip_shards(df: DataFrame, out_dir: str, prefix: str, shards: int | None = None, by: Column | None = None) -> list[str]:
    """Write ``df`` as registry-dialect CSV in zipped archives ``{prefix}{k}.zip`` (one CSV member each):
    ``shards`` of them, or one for each value of ``by`` with that value as k, or one for each partition of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    csv_dir = f"{out_dir}/_csv_{prefix}"
    if by is not None:
        writer = df.withColumn("_shard", by).repartition("_shard").write.partitionBy("_shard")
    else:
        writer = (df.repartition(shards) if shards else df).write
    writer.mode("overwrite").options(**REGISTRY_CSV_WRITE).csv(csv_dir)
    fs, path = _fs_and_path(csv_dir)
    from pyarrow import fs as pafs

    parts = sorted(
        i.path for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and i.base_name.startswith("part-")
    )
    names = [p.split("/_shard=")[1].split("/")[0] if by is not None else k for k, p in enumerate(parts)]
    jobs = [(k, p, f"{out_dir}/{prefix}{name}.zip") for k, (p, name) in enumerate(zip(parts, names))]
    listing = spark.createDataFrame(jobs, "idx int, src string, dst string").repartitionByRange(
        max(len(jobs), 1), "idx"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for src, dst in zip(pdf["src"], pdf["dst"]):
                sfs, spath = _fs_and_path(src)
                dfs, dpath = _fs_and_path(dst)
                tmp = f"{dpath}.{uuid.uuid4().hex}.tmp"
                with dfs.open_output_stream(tmp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    with sfs.open_input_stream(spath) as fh, z.open(spath.rsplit("/", 1)[-1] + ".csv", "w", force_zip64=True) as m:
                        while chunk := fh.read(BLOCK):
                            m.write(chunk)
                dfs.move(tmp, dpath)
                done.append(dst)
            yield pd.DataFrame({"archive": done})

    return sorted(r[0] for r in listing.mapInPandas(run, "archive string").collect())
