"""Stored timelines: a layout that reads of a case, a range of days or a host touch in part only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.timeline import between, bound, of_case, of_host

HOSTS = 8


def _name(c: Column) -> Column:
    return F.lower(F.trim(c))


def _bucket(name: Column, hosts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(hosts)).cast("int")


def write_timeline(events: DataFrame, path: str, *, hosts: int = HOSTS, mode: str = "append", rows_a_file: int = 5_000_000) -> None:
    """Writes events (ts, case_id, and host or hostname) in folders by case, day and bucket of hosts.

    Cases and hosts are filed as they are looked up, trimmed and in lower case; events without case, time or host have folders
    of their own. Rows are dealt by folder once, and a folder with more rows than a task should take is split.
    """
    host = [c for c in ("host", "hostname") if c in events.columns]
    if len(host) != 1:
        raise ValueError("a stored timeline has either host or hostname")
    own = f"host_of_{hosts}"
    filed = events.withColumns({"case_key": _name(F.col("case_id")), "day": F.to_date("ts"), own: _bucket(_name(F.col(host[0])), hosts)})
    filed.hint("rebalance", "case_key", "day", own).write.mode(mode).option("maxRecordsPerFile", rows_a_file).partitionBy("case_key", "day", own).parquet(path)


def read_timeline(spark: SparkSession, path: str, *, case_id: str | None = None, since=None, until=None, host: str | None = None) -> DataFrame:
    """Events of a case, of a range of times (rows without time stay) and of a host; only folders that can hold some are read."""
    rows = spark.read.option("inferSchema", False).schema(_schema(spark, path)).parquet(path)
    own = next(c for c in rows.columns if c.startswith("host_of_"))
    low, high = bound(since), bound(until)
    if case_id is not None:
        rows = of_case(rows.where(F.col("case_key") == case_id.strip().lower()), case_id)
    if low is not None or high is not None:
        day = F.col("day").isNull()
        inside = F.lit(True)
        inside = inside & (F.col("day") >= F.to_date(F.lit(low))) if low is not None else inside
        inside = inside & (F.col("day") <= F.to_date(F.lit(high))) if high is not None else inside
        rows = between(rows.where(day | inside), low, high)
    if host is not None:
        hosts = int(re.fullmatch(r"host_of_(\d+)", own)[1])
        rows = of_host(rows.where(F.col(own) == _bucket(F.lit(host.strip().lower()), hosts)), host)
    return rows.drop("case_key", "day", own)


def _schema(spark: SparkSession, path: str):
    """The schema of the files, with the folders' columns as what they are and not as what their names look like."""
    from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

    found = spark.read.parquet(path).schema
    kinds = {"case_key": StringType(), "day": DateType()}
    return StructType([StructField(f.name, kinds.get(f.name, IntegerType() if f.name.startswith("host_of_") else f.dataType)) for f in found])
