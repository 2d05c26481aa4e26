"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor
costs only the tasks that ran on it, never a cached block that nobody else has.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"file://{tempfile.mkdtemp(prefix='docsift-shared-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing uses yet; removed at exit."""
    path = f"{shared_root(spark)}/docsift-{uuid.uuid4().hex}-{tag}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docsift_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind ``df`` if :func:`written` made it. Nothing may read it later."""
    path = getattr(df, "_docsift_path", None)
    if path:
        remove(df.sparkSession, path)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
