"""Versioned Parquet tables below the shared folder.

``materialise`` writes a derived table once per input fingerprint and reads it
back afterwards, which cuts lineage (the reader starts from files) and lets
many queries share one build.  ``publish`` / ``current`` implement a pointer
swap: a new version is written next to the old one and becomes visible only
when the pointer file is replaced, so readers never see a half-written table.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from firmscope.session import shared_dir


class _FS:
    """Thin access to the Hadoop FileSystem that serves ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.path = self._Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def p(self, path: str):
        return self._Path(path)

    def exists(self, path: str) -> bool:
        return bool(self.fs.exists(self.p(path)))

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """Name, size and modification time of every file at or below ``path``, at any depth."""
        out, found = [], self.fs.listFiles(self.p(path), True)
        while found.hasNext():
            st = found.next()
            out.append((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
        return sorted(out)

    def write_text(self, path: str, text: str) -> None:
        out = self.fs.create(self.p(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        jvm = self._jvm
        reader = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(self.fs.open(self.p(path)), "UTF-8")
        )
        try:
            lines = []
            while True:
                line = reader.readLine()
                if line is None:
                    break
                lines.append(line)
            return "\n".join(lines)
        finally:
            reader.close()

    def rename(self, src: str, dst: str) -> bool:
        return bool(self.fs.rename(self.p(src), self.p(dst)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.p(path), True)

    def list_names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self.p(path)))


class _ArrowFS:
    """The same operations through the Arrow filesystem layer, for sessions
    without a JVM gateway in this process (a Spark Connect client)."""

    def __init__(self, path: str):
        from firmscope.sources.zipshards import _fs_and_path

        self._resolve = _fs_and_path
        self.fs, _ = _fs_and_path(path)

    def _p(self, path: str) -> str:
        return self._resolve(path)[1]

    def exists(self, path: str) -> bool:
        from pyarrow import fs as pafs

        return self.fs.get_file_info(self._p(path)).type != pafs.FileType.NotFound

    def files(self, path: str) -> list[tuple[str, int, int]]:
        from pyarrow import fs as pafs

        info = self.fs.get_file_info(self._p(path))
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info]
        if info.type == pafs.FileType.Directory:
            infos = self.fs.get_file_info(pafs.FileSelector(self._p(path), recursive=True))
        return sorted((i.path, int(i.size or 0), int(i.mtime_ns or 0)) for i in infos if i.is_file)

    def write_text(self, path: str, text: str) -> None:
        parent = self._p(path).rsplit("/", 1)[0]
        self.fs.create_dir(parent, recursive=True)
        with self.fs.open_output_stream(self._p(path)) as out:
            out.write(text.encode("utf-8"))

    def read_text(self, path: str) -> str:
        with self.fs.open_input_stream(self._p(path)) as f:
            return f.read().decode("utf-8")

    def rename(self, src: str, dst: str) -> bool:
        if self.exists(dst):
            return False
        self.fs.move(self._p(src), self._p(dst))
        return True

    def delete(self, path: str) -> None:
        from pyarrow import fs as pafs

        info = self.fs.get_file_info(self._p(path))
        if info.type == pafs.FileType.Directory:
            self.fs.delete_dir(self._p(path))
        elif info.type != pafs.FileType.NotFound:
            self.fs.delete_file(self._p(path))

    def list_names(self, path: str) -> list[str]:
        from pyarrow import fs as pafs

        if not self.exists(path):
            return []
        return sorted(i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self._p(path))))


def fs(spark: SparkSession, path: str):
    """File operations for ``path``: Hadoop FileSystem through the session's
    JVM when there is one, otherwise the Arrow filesystem layer."""
    try:
        jvm = spark.sparkContext._jvm
    except (AttributeError, NotImplementedError):  # a Connect client has no context
        jvm = None
    return _FS(spark, path) if jvm is not None else _ArrowFS(path)


_CODE_VERSION: str | None = None


def code_version() -> str:
    """Hash of this package's source: a stored table built by other code is
    never reused, so its schema always matches the plan that reads it."""
    global _CODE_VERSION
    if _CODE_VERSION is None:
        import importlib.resources

        h = hashlib.sha1()

        def add(folder, name: str) -> None:  # works in a folder and in a ZIP alike
            for item in sorted(folder.iterdir(), key=lambda x: x.name):
                if item.is_dir():
                    add(item, f"{name}{item.name}/")
                elif item.name.endswith(".py"):
                    h.update(f"{name}{item.name}".encode())
                    h.update(item.read_bytes())

        add(importlib.resources.files("firmscope"), "")
        _CODE_VERSION = h.hexdigest()[:12]
    return _CODE_VERSION


def fingerprint(spark: SparkSession, paths: Iterable[str], params: dict | None = None) -> str:
    """Stable hash of the files at or below the input paths (names, sizes and
    modification times, at any depth), the package code and params."""
    h = hashlib.sha1(code_version().encode())
    for path in sorted(paths):
        h.update(f"{os.path.abspath(path) if '://' not in path else path}|{state(spark, path)};".encode())
    h.update(json.dumps(params or {}, sort_keys=True, default=str).encode())
    return h.hexdigest()[:16]


def state(spark: SparkSession, path: str) -> str:
    return hashlib.sha1(repr(fs(spark, path).files(path)).encode()).hexdigest()


def table_root(spark: SparkSession) -> str:
    """Root of materialised tables; ``FIRMSCOPE_NAMESPACE`` isolates a run
    (the benchmark uses a fresh one so every build is measured)."""
    ns = os.environ.get("FIRMSCOPE_NAMESPACE", "default")
    return f"{shared_dir(spark)}/firmscope-tables/{ns}"


def materialise(
    spark: SparkSession,
    name: str,
    key: str,
    build: Callable[[], DataFrame],
    writer: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Return the table ``name`` for fingerprint ``key``, building it if absent.

    Every build writes a folder of its own and becomes visible only by a
    pointer to it, made after the write has succeeded; no folder is ever
    renamed into a name that readers know.  So a lost executor, a failed job or
    another writer never leaves a partial table to be read.  The table is read
    back with the schema of its (lazy) definition, so partition columns keep
    their type and place.
    """
    base = f"{table_root(spark)}/{name}/{key}"
    memo_key = (_session_key(spark), base)
    if memo_key in _MEMO:
        return _MEMO[memo_key]
    plan = build()
    version = current(spark, base)
    if version is None:
        version = new_version_path(spark, base)
        out = writer(plan) if writer is not None else plan
        w = out.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(version)
        publish(spark, base, version)
    df = spark.read.schema(plan.schema).parquet(version).select(*plan.schema.names)
    _MEMO[memo_key] = df
    return df


# Resolved reads of immutable table versions, per session: a version folder
# never changes once published, so its file listing can be reused.
_MEMO: dict[tuple, DataFrame] = {}


def _session_key(spark: SparkSession) -> tuple:
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect client
        app = spark.conf.get("spark.app.id", "")
    return (app, id(spark))


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet input, reusing the resolved read while the file is unchanged."""
    memo_key = (_session_key(spark), path, state(spark, path))
    df = _MEMO.get(memo_key)
    if df is None:
        df = spark.read.parquet(path)
        _MEMO[memo_key] = df
    return df


# --- write-audit-publish ----------------------------------------------------

POINTERS = "_pointers"


def new_version_path(spark: SparkSession, base: str) -> str:
    return f"{base}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, base: str, version_path: str) -> None:
    """Make ``version_path`` the current version of the table at ``base``.

    Each publication adds a new pointer file whose name sorts after every
    earlier one (time-stamped), written under a temporary name and renamed
    into place.  A rename to a fresh name is atomic, nothing is deleted, and
    readers never find the pointer missing.
    """
    import time

    f = fs(spark, base)
    name = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex}"
    tmp = f"{base}/{POINTERS}/.tmp-{name}"
    f.write_text(tmp, version_path)
    if not f.rename(tmp, f"{base}/{POINTERS}/{name}"):
        raise OSError(f"can't publish {version_path}: the pointer {name} was not put in place")


def retain(spark: SparkSession, base: str, keep: int = 3) -> list[str]:
    """Delete the versions published before the last ``keep`` ones, and their pointers; returns the deleted.

    Versions without a pointer (a build that is under way, or one that failed its
    gates) are left alone: only the job that made them knows their state.
    """
    f = fs(spark, base)
    names = [n for n in f.list_names(f"{base}/{POINTERS}") if not n.startswith(".")]
    old = names[:-keep] if keep > 0 else []
    kept = {f.read_text(f"{base}/{POINTERS}/{n}").strip() for n in names[len(old):]}
    gone = []
    for n in old:
        version = f.read_text(f"{base}/{POINTERS}/{n}").strip()
        f.delete(f"{base}/{POINTERS}/{n}")
        if version not in kept:
            f.delete(version)
            gone.append(version)
    return gone


def current(spark: SparkSession, base: str) -> str | None:
    """Path of the published version, resolved once per call."""
    f = fs(spark, base)
    names = [n for n in f.list_names(f"{base}/{POINTERS}") if not n.startswith(".")]
    if not names:
        return None
    return f.read_text(f"{base}/{POINTERS}/{names[-1]}").strip()


def read_current(spark: SparkSession, base: str) -> DataFrame:
    path = current(spark, base)
    if path is None:
        raise FileNotFoundError(f"no published version under {base}")
    return spark.read.parquet(path)
