"""Versioned tables: build once per fingerprint, publish by pointer files."""

import os
import time

from firmscope.plans import store


def test_materialise_builds_once_and_reuses(spark, tmp_dir, monkeypatch):
    monkeypatch.setenv("FIRMSCOPE_NAMESPACE", f"store-{os.path.basename(tmp_dir)}")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumnRenamed("id", "x")

    a = store.materialise(spark, "t", "k1", build)
    b = store.materialise(spark, "t", "k1", build)
    assert a.count() == b.count() == 10 and len(calls) == 1
    store.materialise(spark, "t", "k2", build)
    assert len(calls) == 2
    root = store.table_root(spark).replace("file:", "")
    assert sorted(n for n in os.listdir(f"{root}/t") if not n.startswith("_")) == ["k1", "k2"]


def test_publish_points_to_latest_version(spark, tmp_dir):
    base = f"{tmp_dir}/tbl"
    assert store.current(spark, base) is None
    v1 = store.new_version_path(spark, base)
    spark.range(3).write.parquet(v1)
    store.publish(spark, base, v1)
    time.sleep(0.01)
    v2 = store.new_version_path(spark, base)
    spark.range(5).write.parquet(v2)
    assert store.read_current(spark, base).count() == 3  # written but not yet published
    store.publish(spark, base, v2)
    assert store.current(spark, base) == v2
    assert store.read_current(spark, base).count() == 5


def test_fingerprint_changes_with_params_and_inputs(spark, tmp_dir):
    path = f"{tmp_dir}/in.parquet"
    spark.range(3).write.parquet(path)
    a = store.fingerprint(spark, [path], {"v": 1})
    assert a == store.fingerprint(spark, [path], {"v": 1})
    assert a != store.fingerprint(spark, [path], {"v": 2})
    time.sleep(1.1)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert a != store.fingerprint(spark, [path], {"v": 1})


def test_arrow_backend_matches_the_hadoop_one(spark, tmp_dir):
    from firmscope.plans.store import _ArrowFS, _FS

    for backend in (_FS(spark, tmp_dir), _ArrowFS(tmp_dir)):
        base = f"{tmp_dir}/{type(backend).__name__}"
        backend.write_text(f"{base}/a.txt", "v-1")
        assert backend.exists(f"{base}/a.txt") and backend.read_text(f"{base}/a.txt") == "v-1"
        assert backend.rename(f"{base}/a.txt", f"{base}/b.txt")
        assert backend.list_names(base) == ["b.txt"]
        ((name, size, mtime),) = backend.files(base)
        assert name.endswith("/b.txt") and size == 3 and mtime > 0
        assert backend.files(f"{base}/b.txt") == [(name, size, mtime)]
        backend.delete(base)
        assert not backend.exists(base)


def test_shared_dir_without_a_context():
    from firmscope.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local[2]"}.get(key, default)

    class ConnectLike:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError("no context in a Connect client")

    assert shared_dir(ConnectLike()).startswith("/")


def test_fingerprint_changes_with_the_code(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/in2.parquet"
    spark.range(2).write.parquet(path)
    a = store.fingerprint(spark, [path], {"v": 1})
    monkeypatch.setattr(store, "_CODE_VERSION", "another-build")
    assert store.fingerprint(spark, [path], {"v": 1}) != a


def test_a_leftover_folder_is_never_read(spark, tmp_dir, monkeypatch):
    """A build that died halfway leaves files without a pointer; the next call builds anew."""
    monkeypatch.setenv("FIRMSCOPE_NAMESPACE", f"left-{os.path.basename(tmp_dir)}")
    base = f"{store.table_root(spark)}/t/k"
    spark.range(3).write.parquet(store.new_version_path(spark, base))
    assert store.materialise(spark, "t", "k", lambda: spark.range(100)).count() == 100


def test_fingerprint_sees_files_at_any_depth(spark, tmp_dir):
    path = f"{tmp_dir}/nested"
    spark.range(3).write.parquet(f"{path}/a=1/b=2")
    before = store.fingerprint(spark, [path])
    assert before == store.fingerprint(spark, [path])
    spark.range(3).write.parquet(f"{path}/a=1/b=3")
    assert store.fingerprint(spark, [path]) != before


def test_code_version_of_a_package_in_a_zip(tmp_dir):
    """Run as a ZIP (``--py-files``), the hash is that of the same sources, not of nothing."""
    import shutil
    import subprocess
    import sys

    import firmscope

    root = os.path.dirname(os.path.dirname(firmscope.__file__))
    archive = shutil.make_archive(f"{tmp_dir}/code", "zip", root, "firmscope")
    program = "from firmscope.plans import store; print(store.code_version())"
    env = {**os.environ, "PYTHONPATH": archive}
    got = subprocess.run([sys.executable, "-c", program], cwd="/tmp", env=env, capture_output=True, text=True, check=True)
    store._CODE_VERSION = None
    assert got.stdout.strip() == store.code_version()


def test_a_refused_rename_is_an_error(spark, tmp_dir, monkeypatch):
    import pytest

    monkeypatch.setattr(store._FS, "rename", lambda self, a, b: False)
    with pytest.raises(OSError):
        store.publish(spark, f"{tmp_dir}/tbl", f"{tmp_dir}/tbl/v-1")


def test_retain_deletes_versions_before_the_last(spark, tmp_dir):
    base = f"{tmp_dir}/kept"
    versions = []
    for i in range(4):
        versions.append(store.new_version_path(spark, base))
        spark.range(i + 1).write.parquet(versions[-1])
        store.publish(spark, base, versions[-1])
        time.sleep(0.01)
    unpublished = store.new_version_path(spark, base)
    spark.range(1).write.parquet(unpublished)
    assert store.retain(spark, base, 2) == versions[:2]
    f = store.fs(spark, base)
    assert [f.exists(v) for v in [*versions, unpublished]] == [False, False, True, True, True]
    assert store.read_current(spark, base).count() == 4
