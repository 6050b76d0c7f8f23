"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back: it survives the loss of an executor, is compressed, keeps
statistics for the planner and can be removed as soon as the next one stands.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder of spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = known.get() if known.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lorekeep-")
        spark.sparkContext.setCheckpointDir(known)
    return str(known).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df below the shared folder and returns it read back; `release` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lorekeep/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _OPEN[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._lorekeep_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Removes tables of `materialise` that no later job reads; others are left alone."""
    for df in frames:
        path = getattr(df, "_lorekeep_path", None)
        spark = _OPEN.pop(path, None) if path else None
        if spark is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def _clear() -> None:
    for path, spark in list(_OPEN.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _OPEN.clear()
