"""Tables in the folder that the driver and all executors share, for jobs of several passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. It goes when the driver's JVM ends; only a local master may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    path = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    at, files = _files(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, path: str) -> DataFrame:
    """The table, written and read again: what follows doesn't compute it anew, and needs no executor that made it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; whether there was one."""
    at, files = _files(spark, path)
    return files.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    at, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
