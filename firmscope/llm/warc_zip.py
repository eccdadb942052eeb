"""WARC records in ZIP packages: written by Spark tasks, read back by ranges without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdxj`` (one line per record with its
offset and length).  The reader parses the end record, the ZIP64 locator and
directory, the central directory with its ZIP64 fields and the local headers by
itself, reads the index, and fetches records by byte range.  Index entries are
dealt out in chunks of bounded size, so a large package is read by many tasks.

Every task attempt writes files of new names; the manifest that Spark commits
names those of the winning attempts, and only they are read.

Of records with equal payloads of at least ``min_revisit_bytes`` that with the
smallest id is a ``response``, the others are ``revisit`` records that refer to it.

Defined cases: a null payload is empty; null ids sort last and are read back as
null (a group whose ids are all null has only responses); rows that repeat the
smallest id of their group are all responses; control characters in a URL are
written percent-encoded; very long payloads are written and read whole; an empty
table gives no package and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm.common import scratch, stored, workers
from firmscope.sources.zipshards import _fs_and_path as filesystem

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS_PER_PACKAGE = 20_000
CHUNK_RECORDS, CHUNK_BYTES = 500, 4 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX_KINDS = (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(ident: int | None) -> str:
    return "<urn:x-row:>" if ident is None else f"<urn:x-row:{ident}>"


def _ident(urn: str | None) -> int | None:
    """The row's id in a record id of :func:`record`; None for those of others."""
    digits = (urn or "").removeprefix("<urn:x-row:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdecimal() else None


def record(ident: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, so the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(ident)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP header and payload of one uncompressed record.

    A block that is no HTTP message (of a warcinfo or metadata record, for instance) is all payload.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if not headers.get("content-type", "application/http").lower().startswith("application/http"):
        return headers, b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _content_length(http: bytes) -> int | None:
    """The payload's length that an HTTP header tells, if it tells one."""
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _encoded(http: bytes) -> bool:
    """Whether the payload is kept in another form than its digest or length may mean (chunks, compression)."""
    return any(line.split(b":")[0].strip().lower() in (b"transfer-encoding", b"content-encoding") for line in http.split(b"\r\n")[1:])


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Package:
    """A ZIP package in the making, written to a stream that can't seek."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, at = filesystem(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA_MEMBER, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, ident: int | None, data: bytes) -> None:
        packed = _gzip(data)
        self.data.write(packed)
        entry = {"record": _urn(ident), "filename": "data.warc.gz", "offset": str(self.at), "length": str(len(packed))}
        self.index.append(json.dumps(entry) + "\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as out:
            for line in self.index:
                out.write(line.encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def write_packages(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    folder: str | None = None,
    min_revisit_bytes: int = 0,
    records_per_package: int = RECORDS_PER_PACKAGE,
) -> DataFrame:
    """Write a record per row; returns the manifest (path, records) of the packages."""
    workers(df.sparkSession)
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number: record ids are made of it")
    target = folder or scratch(df.sparkSession, "packages")
    rows = df.select(
        df[id_col].cast("long").alias("id"),
        df[url_col].alias("url"),
        F.encode(F.coalesce(df[payload_col], F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    groups = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("key")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "first")
    )
    marked = rows.join(groups, "key", "left").select(
        "id", "url", "payload", F.expr("CASE WHEN first <=> id THEN NULL ELSE first END").alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package: _Package | None = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for ident, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or _Package(target)
                package.add(ident, record(ident, url, payload, sha1_base32(payload), refers_to))
                if len(package.index) >= records_per_package:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"]
        )

    return stored(marked.mapInArrow(write, "path string, records long"), "packages-manifest")


# ---- reading -----------------------------------------------------------------


@dataclass
class Member:
    name: str
    start: int  # of the data in the file
    size: int
    method: int = 0  # 0: stored, 8: deflated, -1: encrypted


def _read(f: BinaryIO, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"range {start}+{size} reaches beyond the file")
    return data


def _directory(f: BinaryIO, length: int) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory."""
    tail_at = max(0, length - 65_557)
    tail = _read(f, tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory record")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20 and (count == 0xFFFF or 0xFFFFFFFF in (size, offset)):
        locator = _read(f, end_at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record64 = _read(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory record")
            count, size, offset = struct.unpack_from("<QQQ", record64, 32)
    return offset, size, count


def members(f: BinaryIO, length: int) -> list[Member]:
    """The members of a ZIP file, stored or not, from its central directory."""
    offset, size, count = _directory(f, length)
    directory, at, out = _read(f, offset, size), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", directory, at + 20)
        header_at = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        at += 46 + name_len + extra_len + comment_len
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that are full above, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + n :]
        local = _read(f, header_at, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        start = header_at + 30 + sum(struct.unpack_from("<HH", local, 26))
        out.append(Member(name, start, packed, -1 if flags & 1 else method))
    return out


def _blocks(f: BinaryIO, member: Member) -> Iterator[bytes]:
    at, end = member.start, member.start + member.size
    while at < end:
        block = _read(f, at, min(1 << 20, end - at))
        at += len(block)
        yield block


def _inflated(blocks: Iterator[bytes], wbits: int) -> Iterator[bytes]:
    """Of one deflated stream or (31) any number of gzip streams, at most a MB at a time."""
    stream = zlib.decompressobj(wbits)
    begun = False
    for block in blocks:
        while block:
            begun = True
            yield stream.decompress(block, 1 << 20)
            block = stream.unconsumed_tail
            if stream.eof:
                block, begun = stream.unused_data, False
                if wbits < 0:
                    break
                stream = zlib.decompressobj(wbits)
    while begun and not stream.eof:
        if not (more := stream.decompress(stream.unconsumed_tail, 1 << 20)):
            raise ValueError("index ends within a compressed stream")
        yield more


def index_entries(f: BinaryIO, index: Member) -> Iterator[dict]:
    """Entries of an index, read a block at a time."""
    rest = b""
    blocks = _blocks(f, index)
    if index.method == 8:
        blocks = _inflated(blocks, -15)
    if index.name.endswith(".gz"):
        blocks = _inflated(blocks, 31)
    for block in blocks:
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        yield from (_entry(x, index) for x in lines if x.strip())
    if rest.strip():
        yield _entry(rest, index)


def _entry(line: bytes, index: Member) -> dict:
    if b"{" not in line:
        raise ValueError(f"index {index.name} has a line without a JSON entry")
    return json.loads(line[line.index(b"{") :])


def read_packages(manifest: DataFrame, check_digests: bool = True) -> DataFrame:
    """The records of the packages named in column ``path``: id, type, url, digest, payload and what a revisit refers to.

    Packages of other makers are read too.  Record ids that aren't a row's number are null in ``record_id`` and
    ``refers_to`` and whole in ``record_urn`` and ``refers_to_urn``.  A missing SHA-1 digest is computed.  A payload that
    isn't UTF-8 is in ``binary`` in place of ``payload``.  Records that aren't HTTP messages are all payload.  A package
    without an index of JSON entries, and what can't be read by range, is named in an error.
    """
    spark = manifest.sparkSession
    workers(spark)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    found = {m.name: m for m in members(f, f.size())}
                    # A two-level index has its blocks in a member of one of these kinds; the list of blocks isn't needed.
                    indexes = [m for name, m in found.items() if name.startswith("indexes/") and name.endswith(INDEX_KINDS)]
                    if not indexes:
                        raise ValueError(f"no index in {path}")
                    for m in indexes:
                        if m.method not in (0, 8):
                            raise ValueError(f"index {m.name} of {path} can't be read")
                        chunk: list[tuple[int, int]] = []
                        held = 0
                        for entry in index_entries(f, m):
                            if not {"filename", "offset", "length"} <= entry.keys():
                                raise ValueError(f"index {m.name} of {path} has an entry without file name, offset or length")
                            data = found.get("archive/" + entry["filename"])
                            if data is None or data.method != 0:  # compressed or encrypted: can't be read by range
                                raise ValueError(f"archive/{entry['filename']} of {path} is {'missing' if data is None else 'not stored plain'}")
                            start, size = int(entry["offset"]), int(entry["length"])
                            if start + size > data.size:
                                raise ValueError("index entry beyond its archive")
                            chunk.append((data.start + start, size))
                            held += size
                            if len(chunk) >= CHUNK_RECORDS or held >= CHUNK_BYTES:
                                yield _chunk(path, chunk)
                                chunk, held = [], 0
                        if chunk:
                            yield _chunk(path, chunk)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, starts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = filesystem(path)
                rows = []
                with fs.open_input_file(at) as f:
                    for start, size in zip(starts, sizes):
                        raw = _read(f, start, size)
                        try:
                            headers, http, payload = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                        except (ValueError, KeyError, zlib.error) as e:
                            raise ValueError(f"damaged record at {start} of {path}: {e}") from e
                        kind, told = headers.get("warc-type"), _content_length(http)
                        own = headers.get("warc-payload-digest", "")
                        digest = own.removeprefix("sha1:") if own.startswith("sha1:") or ":" not in own else None
                        if kind == "response" and not _encoded(http):
                            if told not in (None, len(payload)) or check_digests and digest and sha1_base32(payload) != digest:
                                raise ValueError(f"damaged record at {start} of {path}")
                        if not digest:
                            digest = None if kind == "revisit" else sha1_base32(payload)
                        try:
                            text = None if kind == "revisit" else payload.decode()
                        except UnicodeDecodeError:
                            text = None
                        rows.append(
                            (
                                _ident(headers.get("warc-record-id")),
                                kind,
                                headers.get("warc-target-uri"),
                                len(payload) if told is None else told,
                                digest,
                                _ident(headers.get("warc-refers-to")),
                                text,
                                headers.get("warc-record-id"),
                                headers.get("warc-refers-to"),
                                payload if text is None and kind != "revisit" else None,
                            )
                        )
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, (_, t) in zip(columns, RECORD_FIELDS)], names=[n for n, _ in RECORD_FIELDS]
                )

    chunks = manifest.select("path").mapInArrow(locate, "path string, starts array<long>, sizes array<long>")
    return chunks.repartition(_fetch_tasks(manifest)).mapInArrow(fetch, RECORD_SCHEMA)


RECORDS_PER_TASK = 50_000


def _fetch_tasks(manifest: DataFrame) -> int:
    """Tasks to read the records: by the manifest's count where it has one, at least the session's shuffle partitions."""
    least = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = manifest.agg(F.sum("records")).first()[0] if "records" in manifest.columns else None
    return max(least, (records or 0) // RECORDS_PER_TASK)


RECORD_FIELDS = [
    ("record_id", pa.int64()),
    ("record_type", pa.string()),
    ("url", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.int64()),
    ("payload", pa.string()),
    ("record_urn", pa.string()),
    ("refers_to_urn", pa.string()),
    ("binary", pa.binary()),
]
RECORD_SCHEMA = (
    "record_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload string,"
    " record_urn string, refers_to_urn string, binary binary"
)


def _chunk(path: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path]),
            pa.array([[s for s, _ in ranges]], pa.list_(pa.int64())),
            pa.array([[n for _, n in ranges]], pa.list_(pa.int64())),
        ],
        names=["path", "starts", "sizes"],
    )


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
       translate(
         to_base(('0x' || substr(hex, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 11, 10))::BIGINT, 32, 8) ||
         to_base(('0x' || substr(hex, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 31, 10))::BIGINT, 32, 8),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN first_id = page_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p
"""
