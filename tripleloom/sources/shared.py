"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it isn't set, a folder of the session's warehouse, which is shared as well."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tripleloom"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    at, system = _at(spark, path)
    system.mkdirs(at.getParent())
    system.deleteOnExit(system.makeQualified(at))
    return path


def written(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: what several parts of
    a plan use is computed once, and a lost executor costs only the tasks that
    read it.  ``done`` are earlier such tables that nothing reads any more."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    remove(spark, *(d.written_at for d in done))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        at, system = _at(spark, path)
        system.delete(at, True)
        system.cancelDeleteOnExit(system.makeQualified(at))
