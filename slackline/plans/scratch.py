"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="slackline-core-"))
    return _LOCAL[0]


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/slackline/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, at: str) -> None:
    """Lazy results read scratch until the application ends; then it is deleted."""
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: the lineage ends here, and a lost executor costs nothing done before."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    forget_at_exit(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
