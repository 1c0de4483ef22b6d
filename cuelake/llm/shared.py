"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only for a local master, whose tasks share the machine, a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder so that a lost executor never recomputes what came before.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes them when nothing refers to them any more.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, wherever that lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
