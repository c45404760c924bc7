"""Correlation of events over time windows.

Input: corr_events (seq, ts, source, event_type, source_ip, username, hostname). ``seq`` is the order of ingestion, which
decides what is first or last. Output: pattern, severity, confidence, seq (of the row that closes the pattern),
source_ip, username, event_count, start_us, end_us and sources (of the events that it rests on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import any_time, capped, case_of, first_text

WINDOW_S, FAILS, USERS, RELATED = 600, 5, 5, 3
OUT = ["pattern", "severity", "confidence", "seq", "source_ip", "username", "event_count", "start_us", "end_us", "sources"]
LATER = "struct<seq: bigint, us: bigint, source: string>"


def event_type(explicit: Column, blob: Column) -> Column:
    """The explicit type where it is known, else the first type of which the text holds a keyword."""
    known = {x: kind for kind, names in T.EXPLICIT_TYPES.items() for x in names}
    named = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.lower(F.trim(explicit))]
    return F.coalesce(named, case_of(F.lower(blob), ((words, kind) for kind, words in T.KEYWORD_TYPES), "unknown"))


def normalized(raw: DataFrame, source: str, seq: str = "seq") -> DataFrame:
    """Raw rows with any of the usual field names as corr_events."""

    def of(*names: str) -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in names if n in raw.columns]
        return first_text(*found) if found else F.lit(None).cast("string")

    times = [F.col(f"`{n}`") for n in ("timestamp", "ts", "time", "event_time", "@timestamp", "TimeCreated") if n in raw.columns]
    blob = F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in raw.columns))
    return raw.select(
        F.col(seq).alias("seq"), (any_time(*times) if times else F.lit(None).cast("timestamp")).alias("ts"), F.lit(source).alias("source"),
        event_type(of("event_type", "type", "action", "EventId", "event_id"), blob).alias("event_type"), of("source_ip", "src_ip", "ip", "remote_ip", "IpAddress").alias("source_ip"),
        of("username", "user", "login", "SubjectUserName", "TargetUserName").alias("username"), of("hostname", "host", "computer", "Computer").alias("hostname"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _timed(events: DataFrame) -> DataFrame:
    return events.where("ts is not null").withColumn("us", F.unix_micros("ts")).withColumn("source_ip", F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown")))


def _slot(us: Column, window_us: int) -> Column:
    """Begin of the stretch of one window's length that a time lies in; keys get it beside them, so that none is one task."""
    return us - F.pmod(us, F.lit(window_us))


def _incident(rows: DataFrame, pattern: str, severity: str, confidence: Column) -> DataFrame:
    return rows.withColumn("pattern", F.lit(pattern)).withColumn("severity", F.lit(severity)).withColumn("confidence", F.round(confidence, 6)).select(*OUT)


def _first(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of each key the row that came in first, with those columns."""
    return rows.groupBy(key).agg(F.min(F.struct("seq", *columns)).alias("r")).select(key, "r.*")


def _after_failures(steps: DataFrame, least: int) -> DataFrame:
    """Of each address the first login that a running sum of openings and closings finds with so many open.

    steps: source_ip, slot, at, step, and of logins (step 0) also seq, us, username and source. Sums run over growing frames.
    """
    open_ = F.sum("step").over(Window.partitionBy("source_ip", "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    flagged = steps.withColumn("n", open_).where(F.col("seq").isNotNull() & (F.col("n") >= least))
    return _first(flagged, "source_ip", "us", "username", "source", "n")


def _with_evidence(found: DataFrame, failed: DataFrame, window_us: int) -> DataFrame:
    """Adds start_us, event_count and sources from the failures of the window before each incident (one an address)."""
    logins = found.withColumn("slot", F.explode(F.array(_slot(F.col("us"), window_us), _slot(F.col("us"), window_us) - window_us)))
    f = failed.select("source_ip", _slot(F.col("us"), window_us).alias("slot"), F.col("us").alias("fus"), F.col("source").alias("fsource"))
    near = logins.join(f, ["source_ip", "slot"]).where(F.col("fus").between(F.col("us") - window_us, F.col("us")))
    rows = near.groupBy("seq", "source_ip", "username", "us", "n", "source").agg(F.count("*").alias("fails"), F.min("fus").alias("start_us"), F.collect_set("fsource").alias("sources"))
    return rows.withColumn("sources", _set(F.concat("sources", F.array("source")))).withColumn("end_us", F.col("us"))


def _set(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(sources, lambda x: x.isNotNull())))


def brute_then_success(events: DataFrame, *, window_s: int = WINDOW_S, fails: int = FAILS) -> DataFrame:
    """The first login of an address after that many failures within the window, equal times included.

    A failure opens at its time; in the next slot it is open from the start until the window is over.
    """
    w = window_s * 1_000_000
    rows, us = _timed(events).where(F.col("event_type").isin("auth_fail", "auth_success")), F.col("us")
    own = _slot(us, w)
    step = lambda slot, at, n: F.struct(slot.alias("slot"), at.alias("at"), F.lit(n).alias("step"))
    failed, login = F.array(step(own, us, 1), step(own + w, own + w, 1), step(own + w, us + w + 1, -1)), F.array(step(own, us, 0))
    of_login = [F.when(F.col("event_type") == "auth_success", F.col(c)).alias(c) for c in ("seq", "us", "username", "source")]
    steps = rows.select("source_ip", *of_login, F.explode(F.when(F.col("event_type") == "auth_fail", failed).otherwise(login)).alias("s")).select("source_ip", "seq", "us", "username", "source", "s.*")
    found = _with_evidence(_after_failures(steps, fails), rows.where("event_type = 'auth_fail'"), w)
    return _incident(found.withColumn("event_count", F.col("n") + 1), "BRUTE_THEN_SUCCESS", "CRITICAL", capped(0.6, 0.01, F.col("n"), 0.95))


def brute_evidence(events: DataFrame, incidents: DataFrame, *, window_s: int = WINDOW_S) -> DataFrame:
    """The failures that each brute-force incident rests on: incident_seq, seq. They meet in slots of one window's length."""
    w, end = window_s * 1_000_000, F.col("end_us")
    found = incidents.select(F.col("seq").alias("incident_seq"), "source_ip", "end_us", F.explode(F.array(_slot(end, w), _slot(end, w) - w)).alias("slot"))
    failed = _timed(events).where("event_type = 'auth_fail'").select("source_ip", "us", "seq", _slot(F.col("us"), w).alias("slot"))
    return found.join(failed, ["source_ip", "slot"]).where(F.col("us").between(end - w, end)).select("incident_seq", "seq")


def spray_then_pivot(events: DataFrame, *, window_s: int = WINDOW_S, users: int = USERS) -> DataFrame:
    """As brute force, over distinct user names.

    Of a user's failures in a slot the first and the last say when the user counts: from the first on, and in the next
    slot until the window after the last is over. The two stretches are united, so that no user counts twice.
    """
    w = window_s * 1_000_000
    rows = _timed(events).where(F.col("event_type").isin("auth_fail", "auth_success")).withColumn("slot", _slot(F.col("us"), w))
    each = rows.where("event_type = 'auth_fail' and username <> ''").groupBy("source_ip", "username", "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    stretch = lambda slot, opens, closes: F.struct(slot.alias("slot"), opens.cast("long").alias("opens"), closes.cast("long").alias("closes"))
    both = F.array(stretch(F.col("slot"), F.col("first"), F.lit(None)), stretch(F.col("slot") + w, F.lit(None), F.col("last") + w + 1))
    each = each.select("source_ip", "username", F.explode(both).alias("s")).groupBy("source_ip", "username", "s.slot").agg(F.min("s.opens").alias("opens"), F.max("s.closes").alias("closes"))
    step = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("step"))
    begin, end, again = step(F.col("slot"), 1), step(F.col("closes"), -1), step(F.col("opens"), 1)
    turns = F.when(F.col("closes").isNull(), F.array(again)).when(F.col("opens") <= F.col("closes"), F.array(begin)).when(F.col("opens").isNull(), F.array(begin, end)).otherwise(F.array(begin, end, again))
    steps = each.select("source_ip", "slot", F.explode(turns).alias("s")).select("source_ip", "slot", "s.*")
    logins = rows.where("event_type = 'auth_success'").select("source_ip", "slot", F.col("us").alias("at"), F.lit(0).alias("step"), "seq", "us", "username", "source")
    found = _with_evidence(_after_failures(logins.unionByName(steps, allowMissingColumns=True), users), rows.where("event_type = 'auth_fail'"), w)
    return _incident(found.withColumn("event_count", F.col("n") + 1), "SPRAY_THEN_PIVOT", "CRITICAL", capped(0.5, 0.02, F.col("n"), 0.9))


def followed(heads: DataFrame, later: DataFrame, keys: list[str], *, window_s: int = WINDOW_S, most: int = RELATED) -> DataFrame:
    """Each head that later rows of one of its keys follow within the window, and the ``most`` of them that came in first.

    Heads and later rows meet slot by slot and never as pairs. What follows a head are the rest of its slot, read
    backwards, and the beginning of the next one: in either the smallest seq so far, the second smallest and so on are
    running minima; a repeated row is one. seq, us, source, source_ip, username and related (array of seq, us, source).
    """
    w, us, none = window_s * 1_000_000, F.col("us"), F.lit(None)
    own = _slot(us, w)
    place = lambda slot, forward, at: F.struct(slot.alias("slot"), F.lit(forward).alias("forward"), at.alias("at"))
    head, row = F.struct("seq", "us", "source", "source_ip", "username"), F.struct("seq", "us", "source")
    parts = []
    for key in keys:
        mine = lambda df, key=key: df.where(F.col(key) != "")
        parts.append(mine(heads).select(F.col(key).alias("key"), F.lit(key).alias("of"), head.alias("head"), none.cast(LATER).alias("v"), F.explode(F.array(place(own, False, -us), place(own + w, True, us + w))).alias("p")))
        parts.append(mine(later).select(F.col(key).alias("key"), F.lit(key).alias("of"), none.cast(heads.select(head.alias("h")).schema["h"].dataType).alias("head"), row.cast(LATER).alias("v"), F.explode(F.array(place(own, False, -us), place(own, True, us))).alias("p")))
    order = Window.partitionBy("key", "of", "p.slot", "p.forward").orderBy("p.at", F.col("head").isNotNull())
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows, value = reduce(DataFrame.unionByName, parts), "v"
    for k in range(most):
        rows = rows.withColumn(f"least{k}", F.min(value).over(so_far))
        if k + 1 < most:
            known = F.min(value).over(before)
            rows = rows.withColumn("known", known).withColumn(f"next{k}", F.when(F.col(value) != F.col("known"), F.greatest(value, "known"))).drop("known")
            value = f"next{k}"
    found = rows.where("head is not null and least0 is not null").select("head", F.filter(F.array(*(f"least{k}" for k in range(most))), lambda x: x.isNotNull()).alias("some"))
    related = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, most)
    return found.groupBy("head").agg(related.alias("related")).select("head.*", "related")


def followed_once(heads: DataFrame, later: DataFrame, key: str, *, window_s: int = WINDOW_S, most: int = RELATED) -> DataFrame:
    """As ``followed`` by one key of which there is one head: later rows meet that head alone, and before they are sorted
    each task keeps only the ``most`` of a key that came in first."""
    head = heads.where(F.col(key) != "").select(F.col(key).alias("key"), F.struct("seq", "us", "source", "source_ip", "username").alias("head"))
    rows = later.select(F.col(key).alias("key"), F.struct("seq", "us", "source").cast(LATER).alias("v"))
    near = rows.join(head, "key").where(F.col("v.us").between(F.col("head.us"), F.col("head.us") + window_s * 1_000_000))
    least = near.withColumn("n", F.dense_rank().over(Window.partitionBy("key").orderBy("v"))).where(F.col("n") <= most)
    return least.groupBy("key", "head").agg(F.array_sort(F.collect_set("v")).alias("related")).select("head.*", "related")


def _chain(rows: DataFrame) -> DataFrame:
    last = F.array_max(F.transform("related", lambda r: r["us"]))
    sources = _set(F.concat(F.array("source"), F.transform("related", lambda r: r["source"])))
    return rows.withColumn("event_count", (F.size("related") + 1).cast("long")).withColumn("start_us", F.col("us")).withColumn("end_us", F.greatest("us", last)).withColumn("sources", sources)


def privilege_escalation(events: DataFrame, *, window_s: int = WINDOW_S) -> DataFrame:
    """The first login of a user that a sudo of the user follows within the window."""
    rows = _timed(events)
    logins, sudos = rows.where("event_type = 'auth_success'"), rows.where("event_type = 'sudo'")
    held = _first(followed(logins, sudos, ["username"], window_s=window_s, most=1), "username", "us", "source", "source_ip")
    return _incident(_chain(followed_once(held, sudos, "username", window_s=window_s)), "PRIVILEGE_ESCALATION", "HIGH", F.lit(0.8))


def persistence(events: DataFrame, *, window_s: int = WINDOW_S) -> DataFrame:
    """Each login that new users or autostarts of the same user or address follow within the window."""
    rows = events.where("ts is not null").withColumn("us", F.unix_micros("ts"))
    held = followed(rows.where("event_type = 'auth_success'"), rows.where(F.col("event_type").isin("user_add", "persistence")), ["username", "source_ip"], window_s=window_s)
    return _incident(_chain(held), "PERSISTENCE", "HIGH", F.lit(0.75))


def recon_then_exploit(events: DataFrame, *, window_s: int = WINDOW_S) -> DataFrame:
    """The scan of an address that came in last, and exploits from it within the window after."""
    rows = _timed(events)
    last = rows.where("event_type = 'net_scan'").groupBy("source_ip").agg(F.max(F.struct("seq", "us", "source", "username")).alias("r")).select("source_ip", "r.*")
    return _incident(_chain(followed_once(last, rows.where("event_type = 'exploit'"), "source_ip", window_s=window_s)), "RECON_THEN_EXPLOIT", "CRITICAL", F.lit(0.85))


def anomalous_time(events: DataFrame, *, start_hour: int = 7, end_hour: int = 19) -> DataFrame:
    """Logins outside working hours, UTC."""
    rows = events.where("ts is not null and event_type = 'auth_success'").withColumn("us", F.unix_micros("ts")).where((F.hour("ts") < start_hour) | (F.hour("ts") >= end_hour))
    rows = rows.withColumn("event_count", F.lit(1).cast("long")).withColumn("start_us", F.col("us")).withColumn("end_us", F.col("us")).withColumn("sources", _set(F.array("source")))
    return _incident(rows, "ANOMALOUS_TIME", "MEDIUM", F.lit(0.6))


def correlate(events: DataFrame, *, window_s: int = WINDOW_S, hours: tuple[int, int] = (7, 19)) -> DataFrame:
    """All rules over one table; six rules read it, so keep it (``persist``) if it is dear to make."""
    rules = [f(events, window_s=window_s) for f in (brute_then_success, spray_then_pivot, privilege_escalation, persistence, recon_then_exploit)]
    return reduce(DataFrame.unionByName, [*rules, anomalous_time(events, start_hour=hours[0], end_hour=hours[1])])


def report(incidents: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row of totals, and the span of time; with events also how many there are and from which sources."""
    totals = incidents.agg(F.count("*").alias("incidents"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.sum("event_count").alias("events"), F.max(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).alias("longest_us"))
    if events is None:
        return totals
    fed = events.groupBy("source").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_events"), F.array_sort(F.collect_set("source")).alias("sources"))
    both = totals.unionByName(fed, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def summary_line(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("summary", F.format_string("[%s] %s from %s: %d events", "severity", "pattern", F.coalesce("source_ip", F.lit("-")), "event_count"))


def select_incidents(incidents: DataFrame, *, pattern: str | None = None, ip: str | None = None, username: str | None = None) -> DataFrame:
    for column, value in (("pattern", pattern), ("source_ip", ip), ("username", username)):
        incidents = incidents.where(F.col(column) == value) if value is not None else incidents
    return incidents
