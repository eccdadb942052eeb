"""Tables stored by key: hashed into buckets and sorted, so that joins and groupings on the key need no exchange.

Every bucket is one file.  Two tables with the same number of buckets are joined
bucket by bucket.  A small file beside the data keeps the key, the number of buckets and
the schema, so that any session can read the table; Spark's catalogue only gets an entry
that points at the folder.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from firmscope.plans import store

LAYOUT = "_keyed.json"
#: Bytes of stored input that one bucket is meant to hold.  A task sorts a bucket as rows, which take twenty to thirty times that.
BUCKET_BYTES = 16 << 20


def _name(path: str) -> str:
    return f"keyed_{hashlib.md5(path.encode()).hexdigest()}"


def buckets_for(input_bytes: int, least: int = 8) -> int:
    return max(least, -(-input_bytes // BUCKET_BYTES))


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` below ``path`` (a new folder) in buckets of ``key``.

    Rows with a null key share a bucket; a key that many rows share makes one large
    bucket, as it would make one large partition of a join.
    """
    spark = df.sparkSession
    # The exchange deals rows out as the buckets do, so each task writes one file.
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))
    layout = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue()}
    store.fs(spark, path).write_text(f"{path}/{LAYOUT}", json.dumps(layout))


def is_keyed(spark: SparkSession, path: str) -> bool:
    return store.fs(spark, path).exists(f"{path}/{LAYOUT}")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table, with its buckets known to the planner."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = json.loads(store.fs(spark, path).read_text(f"{path}/{LAYOUT}"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]).fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`)"
            f" INTO {int(layout['buckets'])} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)
