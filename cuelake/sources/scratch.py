"""Results that are written once, so that a plan doesn't grow by what came before and a lost executor repeats no more than one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for so named results in the one that the cluster shares, spark.checkpoint.dir; a local master gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
    return f"{found}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """The rows as Parquet under the path, read again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
