"""What the operators need from the session: the shared folder and small Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.shared import shared_dir, stored

__all__ = ["arrow_rows", "cut", "plain", "shared_dir", "stored"]


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what a Python worker holds at once; texts can be long, so batches stay short, and never grow again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint that outlives any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra ones can't clash with its own."""
    return df.select(*(df[f"`{c}`"] for c in columns))
