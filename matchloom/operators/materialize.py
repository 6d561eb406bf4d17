"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints, which the command line sets, Spark deletes it once no
    DataFrame refers to it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
