"""A folder for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or else the one that the session was given as its checkpoint folder; without either a temporary folder, if everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = known.get()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir: set it to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of Parquet files in the shared folder: what reads it several times makes it once."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
