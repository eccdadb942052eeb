"""SparkSession construction and the shared working folder.

Cluster jobs write intermediate tables only below ``spark.checkpoint.dir`` (a
shared folder the cluster names).  When the setting is absent — local runs and
tests — a private folder is created once per session and registered as the
checkpoint directory, so the rest of the code has a single place to ask.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lookups are joined without hints: the planner broadcasts a side only when
    # its measured (AQE) or estimated size is below this threshold, and falls
    # back to a shuffled join otherwise.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Post-shuffle partitions (and so Gold and mart files) of about the scan
    # split size; AQE still splits skewed join partitions beyond this.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    app_name: str = "firmscope",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root folder for tables this library writes (Gold, marts, scratch).

    Resolution order: ``spark.checkpoint.dir`` from the session, then a
    checkpoint directory already set on the context.  Only a local-mode
    session may fall back to a private temporary folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect client: no context here
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster run needs a shared folder")
        return tempfile.mkdtemp(prefix="firmscope-", dir=os.environ.get("FIRMSCOPE_TMP"))
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder"
        )
    path = tempfile.mkdtemp(prefix="firmscope-", dir=os.environ.get("FIRMSCOPE_TMP"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def size_shuffles(spark: SparkSession, input_bytes: int, part_bytes: int | None = None) -> int:
    """Set the number of shuffle partitions before coalescing from the size of the input, and return it.

    One partition for each ``part_bytes`` of input (by default the advisory size), at least the
    session's ``spark.sql.shuffle.partitions``; adaptive execution merges what is too small.
    """
    part_bytes = part_bytes or int(DEFAULT_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // part_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the Python workers, whatever folder the driver started in.

    The sources go as one ZIP into the shared folder, once per application, and
    are registered with ``addPyFile``.  A package that already runs from a ZIP
    (``--py-files``) is on the workers' path and is left alone.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                member = os.path.join(os.path.basename(root), os.path.relpath(path, root))
                archive.writestr(zipfile.ZipInfo(member), open(path, "rb").read())
    data = buffer.getvalue()
    target = f"{shared_dir(spark)}/code/{sc.applicationId}/firmscope-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).create(jvm_path, True)
    out.write(bytearray(data))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
