"""Timelines: order, silences, filters and summaries.

Columns used: case_id, ts, source, host, category, severity, actor, target, action, raw; entry_type in interleaved form.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalar import severity_rank

ORDER = ["ts", "source", "action"]


def ordered(events: DataFrame, *, descending: bool = False) -> DataFrame:
    """Deterministic order by time, source and action."""
    return events.orderBy(*(F.col(c).desc() if descending else F.col(c) for c in ORDER))


def seconds(start: str, end: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def parted(rows: DataFrame, key: list[str], order: list[Column], last: list[str], part: str = "part") -> DataFrame:
    """Adds nth (place within the key), and for each of ``last`` its value in the row before, as ``before_`` it.

    Rows are ordered inside the parts of a key (``part`` has to follow the order); what a part needs of those before it is
    a count and one row, so that no task orders a whole key.
    """
    inside, by = Window.partitionBy(*key, part).orderBy(*order), Window.partitionBy(*key).orderBy(part)
    own = rows.withColumn("nth", F.row_number().over(inside)).withColumn("_last", F.lag(F.struct(*last)).over(inside)).alias("r")
    ends = own.groupBy(*(f"r.{k}" for k in (*key, part))).agg(F.count("*").alias("_n"), F.max_by(F.struct(*(f"r.{c}" for c in last)), "r.nth").alias("_end"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_end", F.lag("_end").over(by)).alias("e")
    same = F.lit(True)
    for k in (*key, part):
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}"))
    before = F.coalesce("_last", "_end")
    return own.join(ends, same).select("r.*", F.col("_before"), F.col("_end")).withColumn("nth", F.col("nth") + F.col("_before")).withColumns({f"before_{c}": before[c] for c in last}).drop("_last", "_before", "_end")


def gaps(events: DataFrame, *, threshold_s: float = 300, key: str = "case_id", part: str = "hour") -> DataFrame:
    """Silences longer than the threshold between neighbours of one key: start, end, duration_s."""
    timed = events.where("ts is not null").select(key, "ts", F.date_trunc(part, "ts").alias("part"))
    near = parted(timed, [key], [F.col("ts")], ["ts"]).select(key, F.col("before_ts").alias("start"), F.col("ts").alias("end"))
    return near.select(key, "start", "end", seconds("start", "end").alias("duration_s")).where(F.col("duration_s") > threshold_s)


def global_gaps(events: DataFrame, *, threshold_s: float = 300) -> DataFrame:
    """Silences over all events, without one task for all: inside days, and between the ends of days, a row a day."""
    timed = events.where("ts is not null").select("ts", F.date_trunc("day", "ts").alias("day"))
    inside = timed.select(F.lag("ts").over(Window.partitionBy("day").orderBy("ts")).alias("start"), F.col("ts").alias("end"))
    days = timed.groupBy("day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    between = days.select(F.lag("last").over(Window.orderBy("day")).alias("start"), F.col("first").alias("end"))
    return inside.unionByName(between).withColumn("duration_s", seconds("start", "end")).where(F.col("duration_s") > threshold_s)


def interleaved(events: DataFrame, *, threshold_min: float = 30, key: str = "case_id", part: str = "hour") -> DataFrame:
    """Events and gap rows of each key in one table; pos orders them, a gap stands right before the later event."""
    timed = events.where("ts is not null").withColumn("part", F.date_trunc(part, "ts"))
    placed = parted(timed, [key], [F.col(c) for c in ORDER], ["ts"]).drop("part")
    silence = seconds("before_ts", "ts") / 60
    rows = [c for c in events.columns if c not in ("start", "end", "duration_min", "entry_type", "pos")]
    event = F.struct(F.lit("event").alias("entry_type"), (2 * F.col("nth")).alias("pos"), F.lit(None).cast("double").alias("duration_min"))
    gap = F.struct(F.lit("gap").alias("entry_type"), (2 * F.col("nth") - 1).alias("pos"), F.round(silence, 1).alias("duration_min"))
    both = placed.withColumn("e", F.explode(F.when(silence > threshold_min, F.array(gap, event)).otherwise(F.array(event))))
    is_gap = F.col("e.entry_type") == "gap"
    cells = [F.col(c) if c == key else F.when(~is_gap, F.col(c)).alias(c) for c in rows]
    return both.select(*cells, F.when(is_gap, F.col("before_ts")).alias("start"), F.when(is_gap, F.col("ts")).alias("end"), "e.*")


def at_least(events: DataFrame, severity: str, *, drop_unknown: bool = False) -> DataFrame:
    """Events of that severity or a higher one; gap rows stay, an unknown threshold filters nothing."""
    rank = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}.get(severity.strip().lower())
    if rank is None:
        return events
    own = severity_rank(F.col("severity"), None)
    keep = F.coalesce(own, F.lit(-1 if drop_unknown else 0)) >= rank
    return events.where(keep | (F.col("entry_type") == "gap") if "entry_type" in events.columns else keep)


def equal_text(events: DataFrame, column: str, value: str) -> DataFrame:
    return events.where(F.lower(F.trim(column)) == value.strip().lower())


def in_categories(events: DataFrame, categories: list[str]) -> DataFrame:
    return events.where(F.col("category").isin(categories))


def bound(value) -> datetime.datetime | None:
    """A bound as a time; texts have to be ISO 8601, and what has no zone is UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        try:
            value = datetime.datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"not an ISO 8601 time: {value!r}") from None
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        value = datetime.datetime.combine(value, datetime.time())
    return value if value.tzinfo else value.replace(tzinfo=datetime.UTC)


def between(events: DataFrame, since=None, until=None) -> DataFrame:
    """Inclusive range; rows without time stay. Bounds that are no times or in the wrong order are refused."""
    low, high = bound(since), bound(until)
    if low is not None and high is not None and low > high:
        raise ValueError("since is after until")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("ts") >= F.lit(low))
    if high is not None:
        inside = inside & (F.col("ts") <= F.lit(high))
    return events.where(F.col("ts").isNull() | inside)


def without_gaps(timeline: DataFrame) -> DataFrame:
    return timeline.where("entry_type <> 'gap'")


def of_host(events: DataFrame, host: str) -> DataFrame:
    names = [c for c in ("host", "hostname") if c in events.columns]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.lower(F.trim(c)) == host.strip().lower(), F.lit(False))
    return events.where(hit)


def of_case(events: DataFrame, case_id: str) -> DataFrame:
    names = [F.col(c) for c in ("case_id", "caseId", "case") if c in events.columns]
    return events.where(F.lower(F.trim(F.coalesce(*names))) == case_id.strip().lower())


def with_event_ids(events: DataFrame, ids: list[str], column: str = "event_id") -> DataFrame:
    return events.where(F.col(column).cast("string").isin([str(i) for i in ids]))


def with_service_name(events: DataFrame, part: str) -> DataFrame:
    """Service installations (7045) whose name holds the text."""
    return events.where((F.col("event_id").cast("string") == "7045") & F.lower("target").contains(part.lower()))


def summary(timeline: DataFrame) -> DataFrame:
    """One row: events, gaps, first and last time, minutes of silence."""
    event, gap = F.col("entry_type") == "event", F.col("entry_type") == "gap"
    return timeline.agg(
        F.count_if(event).alias("total_events"), F.count_if(gap).alias("gap_count"), F.min(F.when(event, F.col("ts"))).alias("first_ts"),
        F.max(F.when(event, F.col("ts"))).alias("last_ts"), F.round(F.coalesce(F.sum("duration_min"), F.lit(0.0)), 1).alias("total_gap_minutes"),
    )


def counts(events: DataFrame, *dimensions: str) -> DataFrame:
    """Count by each dimension, one pass: dimension, value, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions)))
    return events.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
