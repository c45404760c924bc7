"""Queries through readers and sinks: derived rows are written to the shared folder and read again; and lines for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import iso
from tracewright.operators import correlate, diff, export, movement, timeline
from tracewright.plans import events as E
from tracewright.plans.derived import duck, view
from tracewright.plans.snapshots import QUERIES as SNAPSHOTS
from tracewright.plans.snapshots import auth_lines, windows_rows
from tracewright.sources import logs, records, timelines, windows
from tracewright.sources.shared import fresh

TL = f"WITH t AS ({duck('timeline')})"
E3 = f"WITH e AS (SELECT * REPLACE (concat('log', seq % 3) AS source) FROM ({duck('corr_events')})), u AS (SELECT *, epoch_us(ts) us FROM e)"
JOINED = "array_to_string(list_sort(list(DISTINCT x)), ',')"
CASE_GAPS = "SELECT *, lag(us) OVER (PARTITION BY case_id ORDER BY us, source, action) p FROM (SELECT *, epoch_us(ts) us FROM t)"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def three_sources(s, d):
    return E.ev(s, d).withColumn("source", F.concat(F.lit("log"), (F.col("seq") % 3).cast("string")))


def with_sources(incidents):
    return incidents.select("pattern", "seq", "start_us", "end_us", F.array_join("sources", ",").alias("sources"))


def backed(pattern: str, ctes: str, head: str, window_us: int) -> str:
    """Incidents of failures: the head (seq, us, source, source_ip) and all failures of the window before it."""
    rows = f"SELECT h.seq, h.us, b.us bus, unnest([b.source, h.source]) x FROM ({head}) h JOIN u b ON b.source_ip = h.source_ip AND b.event_type = 'auth_fail' AND b.us BETWEEN h.us - {window_us} AND h.us"
    return f"{ctes} SELECT '{pattern}' pattern, seq, min(bus) start_us, max(us) end_us, {JOINED} sources FROM ({rows}) GROUP BY seq"


def trailed(pattern: str, ctes: str) -> str:
    """Incidents of what follows: heads h and pairs p, of which the first three count."""
    rows = "SELECT h.seq, h.us, k.rus, unnest([h.source, b.source]) x FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rseq) r FROM p) k JOIN u h ON h.seq = k.seq JOIN u b ON b.seq = k.rseq WHERE r <= 3"
    return f"{ctes} SELECT '{pattern}' pattern, seq, min(us) start_us, max(greatest(us, rus)) end_us, {JOINED} sources FROM ({rows}) GROUP BY seq"


def of_three(text: str) -> str:
    """A text over E with the three sources."""
    assert text.startswith(E.E)
    return E3 + text[len(E.E) :]


SPRAY = f"""{E3}, n AS (SELECT a.seq, a.us, a.source, a.source_ip FROM u a JOIN u b ON b.source_ip = a.source_ip AND b.event_type = 'auth_fail' AND b.us BETWEEN a.us - {E.WEEK}000000 AND a.us WHERE a.event_type = 'auth_success' GROUP BY ALL HAVING count(DISTINCT b.username) >= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq) r FROM n)"""


def event_files(s, d):
    """The timeline as JSON lines with metadata."""
    path = fresh(s)
    rows = E.tl(s, d).select(iso(F.col("ts")).alias("timestamp"), "source", "host", "category", "severity", "actor", "target", "action", "raw", "case_id", F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("metadata"))
    rows.write.json(path)
    return records.read_events(s, path).select("timestamp", "source", "case_id", "severity", F.col("metadata")["seq"].cast("long").alias("seq"))


def observation_files(s, d):
    path = fresh(s)
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("case"), F.col("c_custkey").cast("string")).alias("case_id"), F.lit("t").alias("collected_at"), F.lit("macos").alias("platform"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("observations"))
    rows.write.json(path)
    return records.observations(s, path).select("case_id", "platform", "key", "value")


def snapshot_files(s, d):
    """Processes as JSON objects that hold the rows of a host in a field."""
    path = fresh(s)
    rows = view(s, d, "processes").groupBy("subject").agg(F.collect_list(F.struct("subject", "pid", "ppid", "name", "path")).alias("processes"))
    rows.select("processes").write.option("lineSep", "\n").json(path)
    return records.read_snapshot(s, path, "subject STRING, pid BIGINT, ppid BIGINT, name STRING, path STRING", lines=True)


def supplier_files(s, d):
    """A folder with a file for each supplier, a thousand to a folder of its own."""
    path, key = fresh(s), F.col("s_suppkey")
    files = s.read.parquet(f"{d}/supplier.parquet").select(F.concat_ws("/", F.floor(key / 1000), F.concat(F.lit("k="), key)).alias("path"), F.concat("s_name", F.lit("\n")).alias("content"))
    records.write_files(files.repartition("path"), path)
    return path


def of_suppliers(manifest):
    return manifest.select(F.regexp_extract("path", r"^\d+/k=(\d+)$", 1).cast("long").alias("s_suppkey"), "sha256").where("s_suppkey is not null")


def evidence_files(s, d):
    """The manifest of a folder with a file for each supplier."""
    return of_suppliers(records.evidence(s, supplier_files(s, d)))


def evidence_chunks(s, d):
    """The same with every file hashed by a task that reads it in chunks."""
    return of_suppliers(records.evidence(s, supplier_files(s, d), most=-1))


def stored_timeline(s, d):
    """A case, a host and some days of a timeline that was written by case, day and host."""
    path = fresh(s)
    timelines.write_timeline(E.tl(s, d), path, hosts=2)
    return timelines.read_timeline(s, path, case_id=" CASE7", since="2024-01-05", until="2024-01-25T12:00:00Z", host="HOST3").select("seq", "case_id", "host", F.unix_micros("ts").alias("us"))


def windows_files(s, d):
    path = fresh(s)
    windows_rows(s, d).select("System", "EventData").write.format("xml").option("rootTag", "Events").option("rowTag", "Event").save(path)
    return windows.windows_events(windows.read_windows_xml(s, path)).groupBy("action", "category", F.coalesce("actor", F.lit("-")).alias("actor")).agg(F.count("*").alias("n"), F.max(F.unix_seconds("ts")).alias("last"))


def log_files(s, d):
    path = fresh(s)
    auth_lines(s, d).select("line").write.text(path)
    return logs.auth_events(logs.read_lines(s, path), year=2024).select(F.unix_seconds("ts").alias("at"), "host", "actor", "target", "action")


def written(form: str, **options):
    """Filtered events through the writer of that form, read back as lines or cells."""

    def query(s, d):
        path = fresh(s)
        rows = E.tl(s, d).withColumn("tags", F.when(F.col("seq") % 3 == 1, "T1, T2")).withColumn("k", F.array("seq"))
        export.run(rows, path, form, severity="High", since="2024-01-05T00:00:00Z", until="2024-01-25T00:00:00Z", attack_only=True, **options)
        if form == "csv":
            return s.read.option("header", True).option("escape", '"').csv(path).select("seq", "ts", "k", "case_id", "raw")
        found = s.read.text(path)
        return found.select(F.get_json_object("value", "$.seq").alias("seq"), F.get_json_object("value", "$.severity").alias("severity"), F.get_json_object("value", "$.case_id").alias("case_id"))

    return query


KEPT = "FROM t WHERE severity = 'high' AND seq % 3 = 1 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"
WORDS = ["Accepted password", "LOGIN_SUCCESS", "nothing", "logged in"]
BLOB = "CASE seq % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"
LOGIN = " OR ".join(f"contains(lower(b), '{w}')" for w in T.LOGIN_KEYWORDS)
CHAIN = f"""{E.SEQ}, hosts AS (SELECT source_ip, chain, target_host, min((us, seq)) pos FROM c GROUP BY 1, 2, 3), line AS (SELECT source_ip, chain, string_agg(target_host, ' > ' ORDER BY pos) hosts FROM hosts GROUP BY 1, 2)"""


def keyword_hops(s, d):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("seq") % 4 + 1).cast("int"))
    rows = E.ev(s, d).withColumn("event_type", F.lit("other")).withColumn("message", word)
    return movement.hops(rows, blob=F.col("message")).select("seq", "source_ip", "target_host")


def iso_times(s, d):
    raw = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")).alias("time"))
    return correlate.normalized(raw, "x").select("seq", F.unix_seconds("ts").alias("at"))


def gap_lines(s, d):
    mixed = timeline.interleaved(E.tl(s, d), threshold_min=60).where("entry_type = 'gap'")
    return export.cef_lines(mixed, case_id="c", vendor="v", product="p", version="1")


def csv_cells(s, d):
    return export.csv_rows(timeline.interleaved(E.tl(s, d).drop("start", "end"), threshold_min=60))


QUERIES = {
    "incident_sources": (lambda s, d: with_sources(correlate.brute_then_success(e := three_sources(s, d), window_s=E.WEEK).unionByName(correlate.privilege_escalation(e, window_s=E.DAY)).unionByName(correlate.persistence(e, window_s=E.DAY)).unionByName(correlate.recon_then_exploit(e, window_s=E.WEEK))), " UNION ALL ".join(
        f"SELECT * FROM ({x})" for x in (backed("BRUTE_THEN_SUCCESS", of_three(E.BRUTE), "SELECT * FROM f WHERE r = 1", E.WEEK * 1_000_000), trailed("PRIVILEGE_ESCALATION", of_three(E.PRIV)), trailed("PERSISTENCE", of_three(E.PERSIST)), trailed("RECON_THEN_EXPLOIT", of_three(E.RECON))))),
    "spray_spans": (lambda s, d: with_sources(correlate.spray_then_pivot(three_sources(s, d), window_s=E.WEEK)), backed("SPRAY_THEN_PIVOT", SPRAY, "SELECT * FROM f WHERE r = 1", E.WEEK * 1_000_000)),
    "report_sources": (lambda s, d: (lambda r: r.select("incidents", "total_events", F.array_join("sources", ",").alias("sources")))(correlate.report(correlate.anomalous_time(e := three_sources(s, d)), e)), f"{E3} SELECT count(*) FILTER (event_type = 'auth_success' AND hour(ts) NOT BETWEEN 7 AND 18) incidents, count(*) total_events, array_to_string(list_sort(list(DISTINCT source)), ',') sources FROM u"),
    "known_severities": (lambda s, d: timeline.at_least(E.tl(s, d).withColumn("severity", F.when(F.col("seq") % 5 == 0, "odd").otherwise(F.col("severity"))), "info", drop_unknown=True).select("seq"), f"{TL} SELECT seq FROM t WHERE seq % 5 <> 0"),
    "since_until": (lambda s, d: timeline.between(E.tl(s, d), "2024-01-09", "2024-01-10T12:00:00+02:00").select("seq"), f"{TL} SELECT seq FROM t WHERE ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10 10:00:00'"),
    "event_files": (event_files, f"{TL} SELECT {ISO.format('ts')} AS timestamp, source, case_id, severity, seq FROM t"),
    "observation_files": (observation_files, "SELECT concat('case', c_custkey) case_id, 'macos' platform, k AS key, v AS value FROM (SELECT c_custkey, unnest(['name', 'segment']) k, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END]) v FROM customer) WHERE v IS NOT NULL"),
    "snapshot_files": (snapshot_files, f"WITH t AS ({duck('processes')}) SELECT subject, pid, ppid, name, path FROM t"),
    "evidence_files": (evidence_files, "SELECT s_suppkey, sha256(concat(s_name, chr(10))) sha256 FROM supplier"),
    "evidence_chunks": (evidence_chunks, "SELECT s_suppkey, sha256(concat(s_name, chr(10))) sha256 FROM supplier"),
    "stored_timeline": (stored_timeline, f"{TL} SELECT seq, case_id, host, epoch_us(ts) us FROM t WHERE case_id = 'case7' AND host = 'host3' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'"),
    "windows_event_files": (windows_files, f"SELECT action, category, actor, count(*) n, max(\"at\") AS last FROM ({SNAPSHOTS['windows_events'][1]}) GROUP BY 1, 2, 3"),
    "auth_log_files": (log_files, f"SELECT \"at\", host, actor, target, action FROM ({SNAPSHOTS['auth_log_events'][1]})"),
    "export_run_csv": (written("csv"), f"{TL} SELECT CAST(seq AS VARCHAR) seq, {ISO.format('ts')} AS ts, concat('[', seq, ']') k, case_id, raw {KEPT}"),
    "export_run_jsonl": (written("jsonl"), f"{TL} SELECT CAST(seq AS VARCHAR) seq, severity, case_id {KEPT}"),
    "export_run_timesketch": (written("timesketch"), f"{TL} SELECT CAST(seq AS VARCHAR) seq, severity, case_id {KEPT}"),
    "keyword_logins": (keyword_hops, f"WITH e AS ({duck('corr_events')}) SELECT seq, source_ip, lower(hostname) target_host FROM (SELECT *, {BLOB} b FROM e) WHERE {LOGIN}"),
    "iso_times": (iso_times, "SELECT event_id seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN event_id % 2 = 0 THEN 7200 ELSE 0 END AS at FROM events"),
    "export_cef_gaps": (gap_lines, f"{TL} SELECT concat('CEF:0|v|p|1|timeline_gap|Timeline Gap|3|deviceExternalId=c rt=', us // 1000, ' cat=timeline_gap act=timeline_gap msg={export.REASON} cn1Label=gapMinutes cn1=', round((us - p) / 6e7, 1), ' cs1Label=gapStart cs1=', {ISO.format('make_timestamp(p)')}, ' cs2Label=gapEnd cs2=', {ISO.format('ts')}) AS value FROM ({CASE_GAPS}) WHERE us - p > 3600000000"),
    "export_csv_cells": (csv_cells, f"""{TL} SELECT 'event' entry_type, {ISO.format('ts')} AS timestamp, severity, category, actor, target, action, source source_file, concat(chr(39), raw) raw, '{{}}' metadata, CAST(NULL AS VARCHAR) gap_start, CAST(NULL AS VARCHAR) gap_end, CAST(NULL AS VARCHAR) duration_minutes FROM t
UNION ALL SELECT 'gap', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {ISO.format('make_timestamp(p)')}, {ISO.format('ts')}, CAST(round((us - p) / 6e7, 1) AS VARCHAR) FROM ({CASE_GAPS}) WHERE us - p > 3600000000"""),
    "chain_lines": (lambda s, d: movement.summary_line(movement.sequential(E.hops(s, d), window_s=E.WEEK)).select("source_ip", "summary"), f"{CHAIN} SELECT source_ip, concat(CASE WHEN n >= 3 THEN '[CRITICAL] MULTI_HOP_CHAIN' ELSE '[HIGH] SEQUENTIAL_HOP' END, ' by ', source_ip, ': ', line.hosts) summary FROM g JOIN line USING (source_ip, chain)"),
    "diff_lines": (lambda s, d: diff.summary_line(diff.totals(diff.changes(*E.halves(s, d)))).select("summary"), f"{E.DIFF}, c AS (SELECT 1 added, severity FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {E.SAME}) UNION ALL SELECT 0, severity FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {E.SAME})) SELECT concat(count(*), ' changes: ', count(*) FILTER (added = 1), ' added, ', count(*) FILTER (added = 0), ' removed', CASE WHEN bool_or(added = 1 AND severity IN ('high', 'critical')) THEN ', new high severity' ELSE '' END) summary FROM c"),
}
