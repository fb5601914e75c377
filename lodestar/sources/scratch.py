"""Intermediate and stored tables in the folder that the whole cluster shares.

Tables are written as Parquet below ``spark.checkpoint.dir``, so a lost executor costs the tasks it was running
and nothing that was finished.  Where the session names none, a cluster's warehouse folder is used, and a temporary
folder only in local mode, where driver and executors are one process.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def base_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="lodestar-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lodestar/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used; it is deleted when the process ends."""
    path = f"{base_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once and stored; the returned frame reads the stored table."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:
            continue
        try:
            drop(spark, path)
        except Exception:  # the JVM may have gone first; its folder belongs to the cluster then
            return
