"""Tables and folders in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one (spark.checkpoint.dir); one of its own only where none is set and all runs on this
    machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage: written once to the shared folder and read again."""
    path = shared(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
