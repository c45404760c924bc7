"""Differences between two timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["second", "source", "action_key", "actor", "target"]


def _with_key(events: DataFrame) -> DataFrame:
    return events.withColumn("second", F.date_trunc("second", "ts")).withColumn("action_key", F.lower(F.trim("action")))


def keyed(events: DataFrame) -> DataFrame:
    """One row per key, the last in order of ingestion; the key's time is cut to seconds."""
    rest = [c for c in events.columns if c not in ("source", "actor", "target")]
    return _with_key(events).groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*KEY, "r.*")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each key once, as the row that came in last; the columns are those of the timeline."""
    return keyed(events).select(*events.columns)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """The key and, of either timeline, the last row of that key (a, b; null where it has none), in one aggregation."""
    rest = [c for c in before.columns if c not in ("source", "actor", "target")]
    sides = [_with_key(x).select(*KEY, F.struct(*rest).alias("r"), F.lit(k).alias("side")) for k, x in enumerate((before, after))]
    last = lambda k: F.max_by(F.when(F.col("side") == k, F.col("r")), F.when(F.col("side") == k, F.col("r.seq")))
    return sides[0].unionByName(sides[1]).groupBy(*KEY).agg(last(0).alias("a"), last(1).alias("b"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either timeline that the other lacks, with change = added or removed."""
    one = compared(before, after).where(F.col("a").isNull() | F.col("b").isNull())
    return one.select(*KEY, F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"), F.coalesce("a", "b").alias("r")).select(*KEY, "r.*", "change")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    return compared(before, after).where(F.col("a").isNotNull() & F.col("b").isNotNull()).agg(F.count("*").alias("unchanged"))


def deltas(before: DataFrame, after: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """Counts of each value before and after; the given values are listed even if there are none."""
    rows = keyed(before).select(F.col(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(keyed(after).select(F.col(column).alias("value"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    if values:
        rows = rows.where(F.col("value").isin(values)).unionByName(before.sparkSession.createDataFrame([(v, 0, 0) for v in values], "value string, b int, a int"))
    return rows.groupBy("value").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def largest(deltas_: DataFrame) -> DataFrame:
    return deltas_.orderBy(F.abs("delta").desc(), "value")


def totals(changes_: DataFrame) -> DataFrame:
    added = F.col("change") == "added"
    return changes_.agg(F.count("*").alias("total_changes"), F.count_if(added).alias("added"), F.count_if(~added).alias("removed"), F.coalesce(F.bool_or(added & F.col("severity").isin("high", "critical")), F.lit(False)).alias("has_new_high_severity"))


def added_by_category(changes_: DataFrame) -> DataFrame:
    return changes_.where("change = 'added'").groupBy("category").agg(F.count("*").alias("added"))


def summary_line(totals_: DataFrame) -> DataFrame:
    return totals_.withColumn("summary", F.format_string("%d changes: %d added, %d removed%s", "total_changes", "added", "removed", F.when(F.col("has_new_high_severity"), ", new high severity").otherwise("")))
