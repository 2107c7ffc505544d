"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset the warehouse, or a temporary folder in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found or not re.match(r"local(\[|$)", spark.sparkContext.master):
        return found or spark.conf.get("spark.sql.warehouse.dir")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="textquarry-"))
    return _LOCAL[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again, so its lineage ends there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_splits(spark: SparkSession, most: int = 8 << 20):
    """Within, a task reads no more than some 8 MB of files, or a row group."""
    name = "spark.sql.files.maxPartitionBytes"
    before, now = spark.conf.get(name), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(name, str(min(now, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
