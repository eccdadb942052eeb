"""Delimited-text scan of the registry files and lookup loading.

The registry dialect: ``;`` separator, ``"`` quote doubled as its own escape,
Latin-1, no header, fields may hold newlines, and every row must have the
layout's exact number of columns.  A quoted empty field (``""``) is the empty
string and a bare empty field is null; Spark's CSV reader keeps the two apart
when ``emptyValue`` is ``''`` and ``nullValue`` is a character that never
occurs in the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope import schemas
from firmscope.functions.clean import parse_code, scrub_chars, scrubbed_count
from firmscope.session import ship_package

NEVER_PRESENT = "\u0001"

REGISTRY_CSV_OPTIONS = {
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "encoding": "ISO-8859-1",
    "header": "false",
    "multiLine": "true",
    "mode": "FAILFAST",
    "emptyValue": "",
    "nullValue": NEVER_PRESENT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def scan_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    **overrides: str,
) -> DataFrame:
    """Read positional registry files with a fixed all-text schema.

    ``FAILFAST`` makes a row with too few or too many fields fail the job
    instead of being padded or truncated.  ``multiLine`` keeps quoted line
    breaks inside one field; it makes each file one task, which is why the
    zip expansion cuts archives into several parts at record boundaries.
    Large files given directly are read by :func:`scan_splittable`.
    """
    opts = {**REGISTRY_CSV_OPTIONS, **overrides}
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).options(**opts).csv(paths)


RANGE_SCHEMA = "of_file string, of_range long, number long, file_no long, before long, odd long"
RECORD_SCHEMA = "file_no long, record long, number long, value binary"


class _Range:
    """The records of one byte range, whose lines come in order.

    ``before`` lines of the file with an odd number of quotes stand before it, and it has
    ``odd`` of them itself.  A line is inside quotes if an odd number of such lines stand before it.
    """

    def __init__(self, number: int, file_no: int, before: int, odd: int):
        self.number, self.file_no, self.seen, self.until = number, file_no, before, before + odd
        self.begun = before % 2 == 0  # whether the open record began in this range
        self.open: list[bytes] = []
        self.whole: list[bytes] = []
        self.parts: list[tuple[int, int, int, bytes]] = []

    def _part(self) -> None:
        self.parts.append((self.file_no, self.seen // 2, self.number, b"\n".join(self.open)))
        self.open = []

    def take(self, values: pa.Array) -> pa.Array:
        """Take lines; those that are records by themselves are returned."""
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2 == 1
        inside = (self.seen + np.cumsum(odd) - odd) % 2 == 1
        alone = ~(odd | inside)
        rest = values if not alone.any() else values.filter(pa.array(~alone))
        for value, closes in zip(rest.to_pylist(), odd[~alone].tolist()):
            self.open.append(value)
            if closes and self.seen % 2 == 0:
                self.begun = True
            elif closes and self.begun:
                self.whole.append(b"\n".join(self.open))
                self.open = []
            elif closes:
                self._part()
            self.seen += closes
        return values.filter(pa.array(alone))

    def end(self) -> None:
        if self.seen != self.until:
            raise RuntimeError("a file has changed during the scan")
        if self.open:
            self._part()


def _records(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """The records that lie in one of the byte ranges (number, file_no, before, odd, value), or the parts of the others."""

    def out(rows: list[tuple[int | None, int | None, int | None, bytes]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file_no", "record", "number", "value"])

    def left(its: _Range) -> pa.RecordBatch:
        rows = its.parts if parts else [(None, None, None, value) for value in its.whole]
        its.parts, its.whole = [], []
        return out(rows)

    its = None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)] if len(numbers) else []
        for at, stop in zip(cuts, cuts[1:]):
            if its is None or its.number != numbers[at]:
                if its:
                    its.end()
                    yield left(its)
                its = _Range(*(batch.column(k)[at].as_py() for k in range(4)))
            alone = its.take(batch.column(4).slice(at, stop - at))
            if not parts:
                none = pa.nulls(len(alone), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, alone], names=["file_no", "record", "number", "value"])
            yield left(its)
    if its:
        its.end()
        yield left(its)


def scan_splittable(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    **overrides: str,
) -> DataFrame:
    """The rows of :func:`scan_delimited`, with files of any size read by many tasks.

    Spark's text source cuts a file into byte ranges of whole lines.  A first pass, run at
    once, counts each range's lines with an odd number of quotes; prefix sums over the ranges of a
    file tell whether a range begins inside quotes.  A range that begins outside and has no such
    line holds a record in each line; its lines stay in the JVM and in their task.  The others,
    one row each on the driver, are walked through in order: records that lie in one range are
    put together there, and only the parts of records that go on in another range are shuffled,
    by file and record.  Records are parsed by the JVM's CSV parser with the same options.

    Defined cases: records end with a line feed, with or without a carriage return;
    empty lines between records are skipped; a file that ends inside quotes, a record
    with too few or too many fields, a line separator of another kind, and a file whose
    quotes have changed since the first pass fail the job;
    a quote inside an unquoted field isn't part of the dialect; an empty file has no rows.
    """
    ship_package(spark)
    opts = {**REGISTRY_CSV_OPTIONS, **overrides}
    charset = opts.pop("encoding")
    if opts["quote"] != '"' or opts["escape"] != '"':
        raise ValueError("a splittable scan needs quotes that are escaped by doubling")
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("lineSep", "\n").text(paths)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))  # bytes, not characters: no charset is known here
    walked = _walked(raw, quotes) if lines.filter(quotes % 2 == 1).agg(F.count(F.lit(1))).first()[0] else []
    stripped = F.expr("if(endswith(value, '\\r'), substring(CAST(value AS BINARY), 1, octet_length(value) - 1), CAST(value AS BINARY))")

    def decoded(value: Column) -> Column:
        return F.decode(value, charset).alias("text")

    plain, own = lines, F.lit(True)
    if walked:
        # The texts depend on both sides of this join: a later condition on them can't be moved below it.
        own = F.col("number").isNull()
        of_range = F.broadcast(spark.createDataFrame(walked, RANGE_SCHEMA))
        same = (F.col("file") == F.col("of_file")) & (F.col("range") == F.col("of_range"))
        plain = raw.join(of_range, same, "left").filter(own)
        placed = raw.join(of_range, same).select("number", "file_no", "before", "odd", F.col("value").cast("binary").alias("value"))
        whole = placed.mapInArrow(partial(_records, parts=False), RECORD_SCHEMA).select(F.col("value").cast("string").alias("value"))
        pieces = placed.mapInArrow(partial(_records, parts=True), RECORD_SCHEMA).groupBy("file_no", "record")
        pieces = pieces.agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("parts"))
        joined = pieces.select(F.array_join(F.transform("parts", lambda x: x["value"].cast("string")), "\n").alias("value"))
        whole = whole.union(joined).filter("value NOT IN ('', '\\r')")
    changed = F.raise_error(F.lit("a file has changed during the scan")).cast("binary")
    plain = plain.filter("value NOT IN ('', '\\r')")
    texts = plain.select(decoded(F.when(own & (quotes % 2 == 0), stripped).when(own, changed)))
    if walked:
        texts = texts.union(whole.select(decoded(stripped)))
    parsed = texts.select(F.from_csv("text", schema.simpleString()[len("struct<") : -1].replace(":", " "), {**opts, "lineSep": "\n"}).alias("row"))
    return parsed.select("row.*")


def _walked(raw: DataFrame, quotes: Column) -> list[tuple]:
    """The byte ranges (file, range, value) that aren't a record in each line, as RANGE_SCHEMA."""
    order = Window.partitionBy("file").orderBy("range")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = raw.groupBy("file", "range").agg(F.sum(quotes % 2).alias("odd"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)))
    ranges = ranges.withColumn("total", F.sum("odd").over(Window.partitionBy("file")))
    rows = ranges.filter("odd > 0 OR before % 2 = 1").sort("file", "range").collect()
    if unclosed := [r.file for r in rows if r.total % 2]:
        raise ValueError(f"ends inside quotes: {unclosed[0]}")
    files = {f: k for k, f in enumerate(dict.fromkeys(r.file for r in rows))}
    return [(r.file, r.range, k, files[r.file], r.before, r.odd) for k, r in enumerate(rows)]


def shard_running_total(df: DataFrame, shard: str | Column) -> DataFrame:
    """Rows per shard and the running total in shard order.

    The un-partitioned window runs on one row per shard.
    """
    key = F.col(shard) if isinstance(shard, str) else shard
    counts = df.groupBy(key.alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("shard", "rows", F.sum("rows").over(w).alias("running_total"))


def scrub_report(df: DataFrame, key: str, column: str, chars: str = "\x00") -> DataFrame:
    """Per row: characters removed by ``scrub_chars`` and the length after."""
    return df.select(
        key,
        scrubbed_count(F.col(column), chars).alias("removed"),
        F.length(scrub_chars(F.col(column), chars)).alias("chars_after"),
    )


def scrub_columns(df: DataFrame, columns: Sequence[str] | None = None, chars: str = "\x00") -> tuple[DataFrame, Column]:
    """Strip ``chars`` from string columns; also return the aggregate that
    counts how many were removed."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    removed = sum((F.coalesce(scrubbed_count(F.col(c), chars), F.lit(0)) for c in cols), F.lit(0))
    cleaned = df.select(*[scrub_chars(F.col(c), chars).alias(c) if c in cols else F.col(c) for c in df.columns])
    return cleaned, F.sum(removed).alias("removed_chars")


def reference_from_raw(raw: DataFrame) -> DataFrame:
    """Lookup ``(codigo, descricao)`` text -> ``(code bigint, description)``.

    A code that is not a number becomes null (kept, not dropped); the
    description is trimmed and a missing one stays null.
    """
    return raw.select(
        parse_code(F.col("codigo")).alias("code"),
        F.trim(F.col("descricao")).alias("description"),
    )


def load_reference(
    spark: SparkSession, paths: str | Sequence[str], out_path: str | None = None
) -> DataFrame:
    """Read one lookup file and, when ``out_path`` is given, replace the stored
    table with it (S7)."""
    raw = scan_delimited(spark, paths, schemas.REFERENCE_RAW)
    ref = reference_from_raw(raw)
    if out_path:
        ref.write.mode("overwrite").parquet(out_path)
        return spark.read.parquet(out_path)
    return ref
