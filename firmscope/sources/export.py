"""CSV export of summaries (S13): ``;``-separated, header, UTF-8 with BOM, and a
dated file name.

Only aggregated results are exported, so the frame is written as one part;
the BOM is carried by the first header name, which Spark encodes in UTF-8 as
the three bytes ``EF BB BF`` at the start of the file.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"
#: A single file is for summaries; larger frames are exported as a folder of parts.
MAX_SUMMARY_ROWS = 100_000


def _with_bom(df: DataFrame, bom: bool) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias((BOM + c) if bom and i == 0 else c) for i, c in enumerate(df.columns)])


def _write(df: DataFrame, path: str, sep: str) -> None:
    writer = df.write.option("sep", sep).option("header", "true").option("encoding", "UTF-8")
    writer.option("emptyValue", "").csv(path)


def export_csv(
    df: DataFrame,
    out_dir: str,
    prefix: str,
    on: dt.date,
    sep: str = ";",
    bom: bool = True,
) -> str:
    """Write the summary ``df`` to the one file ``{out_dir}/{prefix}_{yyyymmdd}.csv``; returns its path.

    Frames of more than ``MAX_SUMMARY_ROWS`` rows are refused: use ``export_parts``.
    """
    from firmscope.plans.store import fs

    spark = df.sparkSession
    if df.limit(MAX_SUMMARY_ROWS + 1).count() > MAX_SUMMARY_ROWS:
        raise ValueError(f"more than {MAX_SUMMARY_ROWS} rows: export them in parts")
    tmp = f"{out_dir.rstrip('/')}/_export-{uuid.uuid4().hex}"
    _write(_with_bom(df, bom).coalesce(1), tmp, sep)
    f = fs(spark, out_dir)
    part = next(n for n in f.list_names(tmp) if n.startswith("part-"))
    target = f"{out_dir.rstrip('/')}/{prefix}_{on:%Y%m%d}.csv"
    aside = f"{target}.old-{uuid.uuid4().hex}"
    if f.exists(target) and not f.rename(target, aside):
        raise OSError(f"can't replace {target}")
    if not f.rename(f"{tmp}/{part}", target):
        if f.exists(aside):
            f.rename(aside, target)
        raise OSError(f"can't write {target}")
    for old in (aside, tmp):
        if f.exists(old):
            f.delete(old)
    return target


def export_parts(df: DataFrame, out_dir: str, prefix: str, on: dt.date, sep: str = ";") -> str:
    """Write every row of ``df`` as CSV parts (header in each) to a new folder
    ``{out_dir}/{prefix}_{yyyymmdd}_{id}``; returns its path."""
    target = f"{out_dir.rstrip('/')}/{prefix}_{on:%Y%m%d}_{uuid.uuid4().hex[:8]}"
    _write(df, target, sep)
    return target


def read_export(spark, path: str, sep: str = ";") -> DataFrame:
    """Read an exported file back (header with BOM removed from the first name)."""
    df = spark.read.option("sep", sep).option("header", "true").option("encoding", "UTF-8").csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df
