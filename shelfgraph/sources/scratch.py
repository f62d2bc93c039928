"""Written intermediates in the folder that driver and executors share, and small file operations through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/shelfgraph-work"


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for the caller to write; deleted when the driver ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = file_system(spark, path)
    fs.deleteOnExit(jpath)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage and survives lost executors; deleted when the driver ends."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` settled in files of about so many rows, for work that is long for each row: Spark splits files by their bytes, so a few megabytes of narrow rows are one task.
    Settled, since a filter on what is made of the rows would move below a mere exchange."""
    return settle(df.repartition(max(1, -(-df.count() // rows))), name)
