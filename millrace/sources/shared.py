"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it goes when the application ends.

    Where that is unset: a temporary folder if everything runs in one local process, as in tests,
    and else the warehouse, which executors share too.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = context.master == "local" or context.master.startswith("local[")
        root = f"file://{tempfile.gettempdir()}/millrace-checkpoints" if alone else spark.conf.get("spark.sql.warehouse.dir")
    where = f"{root.rstrip('/')}/millrace-{context.applicationId}"
    if getattr(context, "millrace_dir", None) != where:
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        context.millrace_dir = where
    return where


def removed(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what it holds no longer depends on how it is computed."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
