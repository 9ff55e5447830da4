"""Tables in the shared folder, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, whose machines
    share no such folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """written(df), and aggregates over its rows that the same job observes."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(n) for n, c in aggregates.items()]), label)
    return out, seen.get


def folder_system(spark: SparkSession, path: str):
    """(Hadoop's file system for a path's scheme, the path)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; false if there was none."""
    fs, folder = folder_system(spark, path)
    return fs.delete(folder, True)
