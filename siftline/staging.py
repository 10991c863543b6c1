"""Intermediate tables in the folder that all machines of a cluster share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests, a
laptop) does this module choose one, under /tmp/checkpoints. Each application has a folder of its own there, which
Hadoop deletes when the driver's JVM ends, or ``clean`` before that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "file:///tmp/checkpoints"
#: Rows up to which a written table of few columns is sent to all executors: a few MB.
SMALL_ROWS = 20_000
#: The same for a table of one number: some 20 MB.
SMALL_IDS = 1_000_000
_announced: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}"
    if folder not in _announced:
        _announced.add(folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: when executors are lost later, only the reading is repeated. The table stays until ``drop``,
    or until ``clean`` at the application's end, as results that aren't computed yet may read it.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def lookup(table: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of few columns for joins: broadcast if its rows are counted to be few (``most``), else as it is.

    A table of many rows lies in many small files, so that its size in bytes alone would tell Spark little."""
    return F.broadcast(table) if table.count() <= (SMALL_ROWS if most is None else most) else table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that came from them is staged itself."""
    for df in tables:
        if path := getattr(df, "_siftline_path", None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged, once its results are written."""
    _delete(spark, _own_dir(spark))
