"""Queries on streams: the derived tables are replayed as files, out of order, and what the stream has written is read again.

The SQL is that of the batch operators: over all rows, none of which is late here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import diff
from tracewright.plans import events as E
from tracewright.plans.derived import duck
from tracewright.sources.shared import fresh
from tracewright.streaming import ordered

STRETCH, STRETCHES, LATE = 8, 5, "10 days"


def replayed(spark: SparkSession, rows: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over files of the rows writes, from its first file to a last row that closes all windows.

    A file holds days of a stretch and, of every second row, those of the day before, so times go back and forth by up to
    nine days within and between files.
    """
    path = fresh(spark)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    day = F.datediff("ts", F.lit(first)) + F.col("seq") % 2
    stretch = F.least(F.floor(day / STRETCH), F.lit(STRETCHES - 1))
    for k in range(STRETCHES):
        rows.where(stretch == k).write.mode("append").parquet(f"{path}/in")
    end = F.lit(last).cast("timestamp") + F.expr("INTERVAL 400 DAYS")
    rows.limit(1).withColumn("ts", end).write.mode("append").parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // (STRETCHES + 1))).parquet(f"{path}/in")
    query = ordered.write_changes(stream(source), f"{path}/out", f"{path}/checkpoint", availableNow=True)
    query.awaitTermination()
    return ordered.read_changes(spark, f"{path}/out")


def deduplicated(s, d):
    return diff.deduplicated(E.tl(s, d)).select("seq", "case_id", "source", "actor")


DEDUP = f"WITH t AS ({duck('timeline')}) SELECT seq, case_id, source, actor FROM ({E.KEYED} true) WHERE r = 1"


def of(name: str) -> str:
    return E.QUERIES[name][1]


QUERIES = {
    "stream_spray_then_pivot": (lambda s, d: ordered.standing(replayed(s, E.ev(s, d), lambda x: ordered.spray_then_pivot(x, window_s=E.WEEK, late=LATE))).drop("start_us", "sources"), of("spray_then_pivot")),
    "stream_brute_then_success": (lambda s, d: ordered.standing(replayed(s, E.ev(s, d), lambda x: ordered.brute_then_success(x, window_s=E.WEEK, late=LATE))).drop("sources"), of("brute_then_success")),
    "stream_recon_then_exploit": (lambda s, d: ordered.standing(replayed(s, E.ev(s, d), lambda x: ordered.recon_then_exploit(x, window_s=E.WEEK, late=LATE))).drop("sources"), of("recon_then_exploit")),
    "stream_persistence": (lambda s, d: replayed(s, E.ev(s, d), lambda x: ordered.persistence(x, window_s=E.DAY, late=LATE)).drop("sources"), of("persistence")),
    "stream_sequential_hops": (
        lambda s, d: replayed(s, E.hops(s, d), lambda x: ordered.sequential(x, window_s=E.WEEK, late=LATE)).select(
            "source_ip", "pattern", "severity", "confidence", "hop_count", F.size("target_hosts").cast("long").alias("hosts"), F.element_at("target_hosts", 1).alias("first_host"), F.array_join("usernames", ",").alias("usernames"), "start_us", "end_us"
        ),
        of("sequential_hops"),
    ),
    "stream_gaps": (lambda s, d: replayed(s, E.tl(s, d), lambda x: ordered.gaps(x, threshold_s=3600, late=LATE)).select("case_id", *E.us("start", "end"), "duration_s"), of("gaps")),
    "stream_interleaved_timeline": (lambda s, d: replayed(s, E.tl(s, d), lambda x: ordered.interleaved(x, threshold_min=60, late=LATE)).select("case_id", "entry_type", "pos", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("duration_min", F.lit(0.0)).alias("duration_min")), of("interleaved_timeline")),
    "stream_deduplicated_timeline": (lambda s, d: replayed(s, E.tl(s, d), lambda x: ordered.deduplicated(x, late=LATE)).select("seq", "case_id", "source", "actor"), DEDUP),
    "deduplicated_timeline": (deduplicated, DEDUP),
}
