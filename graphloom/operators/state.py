"""Cutting the lineage of loop state, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and the master is local."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept below the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def newest(spark: SparkSession, folder: str, marker: str = "_SUCCESS") -> int:
    """The greatest number n of the folders g<n> below folder that hold the marker, as whole writes do; 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    return max((int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(path(p, marker))), default=0)
