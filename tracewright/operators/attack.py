"""Mapping of actions to attack techniques, and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import tables as T

FIELDS = ["technique_id", "technique", "tactic", "confidence"]


def technique_table(spark) -> DataFrame:
    return spark.createDataFrame(T.TECHNIQUES, "action_key string, technique_id string, technique string, tactic string, confidence string")


def mapped(events: DataFrame) -> DataFrame:
    """Adds technique columns: by the whole action, else by the first keyword that it holds; null if neither."""
    action = F.lower(F.trim("action"))
    exact = events.withColumn("__key", action).join(F.broadcast(technique_table(events.sparkSession)), F.col("__key") == F.col("action_key"), "left")
    word = None
    for keyword, *values in T.TECHNIQUE_KEYWORDS:
        row = F.struct(*(F.lit(v).alias(n) for n, v in zip(FIELDS, values, strict=True)))
        hit = action.contains(keyword)
        word = F.when(hit, row) if word is None else word.when(hit, row)
    return exact.withColumn("__w", word).select(*(events[c] for c in events.columns), *(F.coalesce(F.col(f), F.col(f"__w.{f}")).alias(f) for f in FIELDS))


def tagged(events: DataFrame) -> DataFrame:
    """Adds attack_tags from event id, process name and command line."""
    eid, text = F.col("event_id").cast("string"), F.lower(F.concat_ws(" ", "process_name", "command_line"))
    tags = F.array(F.when(eid == "4625", "T1110"), F.when(eid == "4624", "T1078"), F.when(eid == "7045", "T1543.003"), F.when(text.contains("powershell"), "T1059"))
    return events.withColumn("attack_tags", F.filter(tags, lambda t: t.isNotNull()))


def techniques(mapped_: DataFrame) -> DataFrame:
    return mapped_.where("technique_id is not null").groupBy("technique_id", "tactic").agg(F.count("*").alias("n"))


def top(mapped_: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent techniques or tactics, ties by name."""
    return mapped_.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def coverage(mapped_: DataFrame) -> DataFrame:
    total, known = F.count("*"), F.count("technique_id")
    return mapped_.agg(total.alias("total"), known.alias("mapped"), (total - known).alias("unmapped"), F.round(F.when(total > 0, 100.0 * known / total).otherwise(0.0), 1).alias("coverage_pct"), F.count_distinct("technique_id").alias("techniques"))
