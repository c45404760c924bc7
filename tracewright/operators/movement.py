"""Login movement between hosts: hops, sequential chains, fan-out and credential reuse.

Hops: seq, ts (may be null), source_ip, target_host, username.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import capped
from tracewright.operators.timeline import parted

WINDOW_S, HOSTS = 3600, 3


def is_login(kind: Column, blob: Column) -> Column:
    """A successful login by its type, else by the text."""
    hit = F.lower(F.trim(kind)).isin(T.LOGIN_TYPES)
    for word in T.LOGIN_KEYWORDS:
        hit = hit | F.lower(blob).contains(word)
    return F.coalesce(hit, F.lit(False))


def host_name(host: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(host, "^/+", "")))


def hops(events: DataFrame, *, blob: Column | None = None) -> DataFrame:
    """Successful logins that name an address or a host; what is missing is "unknown"."""
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in events.columns)) if blob is None else blob
    ip, host, user = (F.nullif(F.trim(c), F.lit("")) for c in ("source_ip", "hostname", "username"))
    rows = events.where(is_login(F.col("event_type"), text)).where(ip.isNotNull() | host.isNotNull())
    unknown = F.lit("unknown")
    return rows.select("seq", "ts", F.coalesce(ip, unknown).alias("source_ip"), F.coalesce(host_name(host), unknown).alias("target_host"), F.coalesce(user, unknown).alias("username"))


def sequential(hops_: DataFrame, *, window_s: int = WINDOW_S) -> DataFrame:
    """Chains of at least two hops of an address to another host each, no more than the window apart.

    Chains of three and more are MULTI_HOP_CHAIN. A hop without time stands last and never expires. Hops are ordered
    inside slots of one window's length, and slots only hand on their last hop, so that a busy address is not one task.
    """
    order, us = [F.col("ts").asc_nulls_last(), F.col("seq")], F.unix_micros("ts")
    slot = F.coalesce(us - F.pmod(us, F.lit(window_s * 1_000_000)), F.lit((1 << 63) - 1))
    rows = parted(hops_.withColumn("slot", slot), ["source_ip"], order, ["target_host"], part="slot").drop("nth")
    kept = rows.where(F.col("before_target_host").isNull() | (F.col("before_target_host") != F.col("target_host"))).drop("before_target_host")
    apart = parted(kept, ["source_ip"], order, ["ts"], part="slot")
    chained = apart.withColumn("cut", F.when(us - F.unix_micros("before_ts") > window_s * 1_000_000, F.col("nth")).otherwise(0))
    # a chain is named after its first hop, which is the last cut so far: inside slots, then over the cuts of slots
    inside = chained.withColumn("chain", F.max("cut").over(Window.partitionBy("source_ip", "slot").orderBy("nth")))
    slots = chained.groupBy("source_ip", "slot").agg(F.max("cut").alias("top")).withColumn("known", F.max("top").over(Window.partitionBy("source_ip").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    named = inside.join(slots, ["source_ip", "slot"]).withColumn("chain", F.greatest("chain", F.coalesce("known", F.lit(0))))
    hosts = named.groupBy("source_ip", "chain", "target_host").agg(F.count("*").alias("n"), F.min("nth").alias("nth"), F.collect_set("username").alias("usernames"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))
    grouped = hosts.groupBy("source_ip", "chain").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "target_host"))).alias("hosts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("usernames")))).alias("usernames"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).where("n >= 2")
    base = capped(0.4, 0.1, F.col("n"), 0.9)
    long = F.col("n") >= 3
    return grouped.select(
        "source_ip", F.when(long, "MULTI_HOP_CHAIN").otherwise("SEQUENTIAL_HOP").alias("pattern"), F.when(long, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.round(F.when(long, F.least(F.lit(0.95), base + 0.1)).otherwise(base), 6).alias("confidence"), F.col("n").alias("hop_count"),
        F.transform("hosts", lambda h: h["target_host"]).alias("target_hosts"), "usernames", "start_us", "end_us",
    )


def fan_out(hops_: DataFrame, *, window_s: int = WINDOW_S, hosts: int = HOSTS) -> DataFrame:
    """Addresses that reach that many hosts within the window after their first timed hop; untimed hops count.

    What is near the first hop lies in its slot of one window's length or in the next, so only rows of two slots meet it. Hops
    are summed up by address, host and user, then by address and host, before anything of an address comes together.
    """
    us, w = F.unix_micros("ts"), window_s * 1_000_000
    slot = F.col("us") - F.pmod("us", F.lit(w))
    rows = hops_.select("source_ip", "target_host", "username", us.alias("us"))
    first = rows.where("us is not null").groupBy("source_ip").agg(F.min("us").alias("first"))
    slots = first.select("source_ip", "first", F.explode(F.array(slot_of := F.col("first") - F.pmod("first", F.lit(w)), slot_of + w)).alias("slot"))
    timed = rows.where("us is not null").withColumn("slot", slot).join(slots, ["source_ip", "slot"]).where(F.col("us") - F.col("first") <= w)
    both = timed.select("source_ip", "target_host", "username", "us").unionByName(rows.where("us is null"))
    pairs = both.groupBy("source_ip", "target_host", "username").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    ranges = [F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")]
    hosts_ = pairs.groupBy("source_ip", "target_host").agg(F.collect_set("username").alias("users"), *ranges)
    found = hosts_.groupBy("source_ip").agg(F.array_sort(F.collect_list("target_host")).alias("target_hosts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("users")))).alias("usernames"), *ranges).where(F.size("target_hosts") >= hosts)
    return found.select("source_ip", F.lit("FAN_OUT").alias("pattern"), F.lit("HIGH").alias("severity"), F.round(capped(0.4, 0.05, F.size("target_hosts"), 0.85), 6).alias("confidence"), F.col("n").alias("hop_count"), "target_hosts", "usernames", "start_us", "end_us")


def credential_reuse(hops_: DataFrame) -> DataFrame:
    """Users seen on two hosts or more; the address is that of the earliest hop. Hops are summed up by user and host first."""
    us = F.unix_micros("ts")
    earliest = F.min(F.struct(F.col("ts").isNull(), "ts", "seq", "source_ip")).alias("earliest")
    pairs = hops_.groupBy("username", "target_host").agg(F.count("*").alias("n"), earliest, F.min(us).alias("start_us"), F.max(us).alias("end_us"))
    found = pairs.groupBy("username").agg(F.array_sort(F.collect_list("target_host")).alias("target_hosts"), F.sum("n").alias("hop_count"), F.min("earliest").alias("earliest"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).where(F.size("target_hosts") >= 2)
    return found.select(F.col("earliest.source_ip").alias("source_ip"), F.lit("CREDENTIAL_REUSE").alias("pattern"), F.lit("MEDIUM").alias("severity"), F.round(capped(0.5, 0.05, F.size("target_hosts"), 0.8), 6).alias("confidence"), "hop_count", "target_hosts", F.array("username").alias("usernames"), "start_us", "end_us")


def chains(hops_: DataFrame, *, window_s: int = WINDOW_S, hosts: int = HOSTS) -> DataFrame:
    return sequential(hops_, window_s=window_s).unionByName(fan_out(hops_, window_s=window_s, hosts=hosts)).unionByName(credential_reuse(hops_))


def report(chains_: DataFrame) -> DataFrame:
    """One row of totals; hosts are told apart over all chains."""
    rows = chains_.select("severity", "hop_count", F.posexplode("target_hosts").alias("i", "host"))
    head = F.col("i") == 0
    return rows.agg(F.count_if(head).alias("chains"), F.count_if(head & (F.col("severity") == "CRITICAL")).alias("critical"), F.count_if(head & (F.col("severity") == "HIGH")).alias("high"), F.sum(F.when(head, F.col("hop_count"))).alias("hops"), F.count_distinct("host").alias("unique_hosts"))


def through_host(chains_: DataFrame, host: str) -> DataFrame:
    return chains_.where(F.array_contains("target_hosts", host.lower()))


def summary_line(chains_: DataFrame) -> DataFrame:
    return chains_.withColumn("summary", F.format_string("[%s] %s by %s: %s", "severity", "pattern", F.coalesce("source_ip", F.lit("-")), F.array_join("target_hosts", " > ")))
