"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; what lies there is scratch once the application has ended.

    Only on a local master may the setting be missing, as in tests; then the folder is one of this machine.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{context.applicationId}"


def fresh(spark: SparkSession) -> str:
    """A new path in it."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written there as Parquet and read again: like a checkpoint, but small, and read by columns."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
