import os
import sys
import tempfile
import uuid

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

# Tables built by tests go to their own namespace below the shared folder.
os.environ.setdefault("FIRMSCOPE_NAMESPACE", f"tests-{uuid.uuid4().hex[:8]}")

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from firmscope.session import DEFAULT_CONF

    builder = SparkSession.builder.master("local[*]").appName("firmscope-tests")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", "8")
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    """A fresh folder below the shared folder for files a test writes."""
    from firmscope.session import shared_dir

    path = f"{shared_dir(spark)}/firmscope-tests/{uuid.uuid4().hex}"
    if path.startswith("file:"):
        path = path[len("file:"):]
    if ":" in path:
        pytest.skip("tests that write files need a local shared folder")
    os.makedirs(path, exist_ok=True)
    return path


@pytest.fixture()
def local_tmp():
    return tempfile.mkdtemp(prefix="firmscope-test-", dir="/tmp")
