"""The folder that driver and executors share, and tables written there for the length of an application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a local session gets a temporary folder and a cluster has to name one."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    files.deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again, so that its lineage ends there."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with `_range`, numbered in this order: ranges of about equal size, cut at sampled quantiles, so that windows over
    a range and then over the ranges take the place of one over all rows.  Equal rows share a range.  It is written once, as
    another run could cut elsewhere."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
