"""Helpers that the operators share: tables, shared scratch folders, fresh column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from firmscope.session import shared_dir, ship_package

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (nothing is created)."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends, not when the driver's collector finds their plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives a lost executor.

    The shuffle files of the write are removed after it; :func:`discard` removes the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`stored` returned and that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a Python task gets at a time: texts may be very long.
BATCH_ROWS = 1000


def workers(spark: SparkSession) -> None:
    """Call before a plan with Python code in tasks: ships the package, keeps batches small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


PARTITION_BYTES = 128 << 20
MOST_PARTITIONS = 100_000


def partitions(df: DataFrame, growth: float = 1.0) -> int:
    """Into how many parts to deal ``df`` where adaptive execution can't choose: from the size of its input.

    One part for each ``PARTITION_BYTES`` of the files that the plan reads, times
    ``growth``, at least the session's ``spark.sql.shuffle.partitions``.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # rows from the driver have no known size, and are few
    wanted = min(MOST_PARTITIONS, int(growth * size) // PARTITION_BYTES + 1)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
