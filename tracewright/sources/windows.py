"""Windows event exports in XML to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.sources.logs import _metadata

SCHEMA = "System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>>, EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
LOGON, GROUP = ["4624", "4625", "4648"], ["4728", "4732", "4756"]


def read_windows_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of System and EventData, split at Event tags by the reader; a malformed file gives none."""
    return spark.read.format("xml").option("rowTag", "Event").schema(SCHEMA).load(path).select("*", F.col("_metadata.file_name").alias("source")).where("System is not null")


def data(name: str) -> Column:
    """The first non-empty value of that name."""
    return F.nullif(F.get(F.filter("EventData.Data", lambda x: x["_Name"] == name), 0)["_VALUE"], F.lit(""))


def windows_events(rows: DataFrame) -> DataFrame:
    """Events by a table of ids; rows without whole id or valid time are skipped."""
    eid = F.trim("System.EventID").try_cast("bigint").cast("string")
    table = rows.sparkSession.createDataFrame(T.WINDOWS_EVENTS, "event_id string, category string, severity string, action string")
    rows = rows.withColumn("event_id", eid).withColumn("ts", F.col("System.TimeCreated._SystemTime").try_cast("timestamp")).where("event_id is not null and ts is not null")
    known = rows.join(F.broadcast(table), "event_id", "left")
    logon, group, service = F.col("event_id").isin(LOGON), F.col("event_id").isin(GROUP), F.col("event_id") == "7045"
    return known.select(
        "ts", "source", F.lit(None).cast("string").alias("host"), F.coalesce("category", F.lit("system")).alias("category"), F.coalesce("severity", F.lit("info")).alias("severity"),
        F.when(logon, F.coalesce(data("IpAddress"), data("WorkstationName"))).when(group, data("SubjectUserName")).alias("actor"),
        F.when(logon, data("TargetUserName")).when(group, data("MemberName")).when(service, data("ServiceName")).alias("target"),
        F.coalesce("action", F.concat(F.lit("windows_event_"), "event_id")).alias("action"), F.substring(F.to_json(F.struct("System", "EventData")), 1, 500).alias("raw"),
        _metadata(event_id=F.col("event_id"), logon_type=F.when(logon, data("LogonType")), auth_package=F.when(logon, data("AuthenticationPackageName")), group_name=F.when(group, data("TargetUserName")), service_file=F.when(service, data("ImagePath")), service_type=F.when(service, data("ServiceType"))).alias("metadata"),
    )
