"""Bulk exports of timelines: JSON lines, ECS, CEF, CSV, Timesketch. Each gives lines or columns, and a writer.

Input: interleaved or plain events; gap rows have entry_type = "gap" and start, end, duration_min.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import escape_cef_extension, escape_cef_header, formula_safe, is_ip, iso, lookup
from tracewright.operators.records import attack_tags
from tracewright.operators.timeline import between, equal_text

#: A sentence of the output, and the keys that a host is looked for under.
REASON = "No timeline events were observed between adjacent evidence entries."
HOST_KEYS = ("target_host", "target_hostname", "hostname", "host", "computer", "destination_host")


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _is_gap(df: DataFrame) -> Column:
    return F.coalesce(_column(df, "entry_type") == "gap", F.lit(False))


def metadata_host(df: DataFrame) -> Column:
    if "metadata" not in df.columns:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.nullif(F.trim(F.col("metadata")[k]), F.lit("")) for k in HOST_KEYS))


def json_lines(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def ecs_lines(timeline: DataFrame, *, case_id: str, product: str) -> DataFrame:
    """One document a row; nulls are left out."""
    severity = lookup(F.lower("severity"), T.ECS_SEVERITY, 1)
    category = F.coalesce(F.create_map(*(x for k, v in T.ECS_CATEGORY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.lower("category")], F.array(F.lit("host")))
    ip = is_ip(F.col("actor"))
    host = metadata_host(timeline)
    version, observer = F.struct(F.lit("8.11.0").alias("version")).alias("ecs"), F.struct(F.lit(product).alias("product")).alias("observer")
    event = F.to_json(F.struct(
        iso(F.col("ts")).alias("@timestamp"), version,
        F.struct(F.lit("event").alias("kind"), category.alias("category"), F.array(F.lit("info")).alias("type"), F.col("action").alias("action"), severity.alias("severity"), severity.alias("risk_score"), F.col("raw").alias("original")).alias("event"),
        F.col("raw").alias("message"), F.struct(F.struct(F.col("source").alias("path")).alias("file")).alias("log"), F.struct(F.lit(case_id).alias("case_id"), F.col("category").alias("dfir_category")).alias("labels"), observer,
        F.struct(F.col("target").alias("target"), _column(timeline, "metadata", "map<string,string>").alias("metadata")).alias("dfir"),
        F.when(ip, F.struct(F.col("actor").alias("ip"))).alias("source"), F.when(~ip & (F.col("actor") != ""), F.struct(F.col("actor").alias("name"))).alias("user"),
        F.when(ip | host.isNotNull(), F.struct(F.when(ip, F.array("actor")).alias("ip"), F.when(host.isNotNull(), F.array(host)).alias("hosts"))).alias("related"),
    ))
    start, end, minutes = _column(timeline, "start", "timestamp"), _column(timeline, "end", "timestamp"), _column(timeline, "duration_min", "double")
    gap = F.to_json(F.struct(
        iso(end).alias("@timestamp"), version,
        F.struct(F.lit("state").alias("kind"), F.array(F.lit("configuration")).alias("category"), F.array(F.lit("info")).alias("type"), F.lit("timeline_gap").alias("action"), F.lit(REASON).alias("reason"), (minutes * 60_000_000_000).cast("long").alias("duration")).alias("event"),
        F.struct(F.lit(case_id).alias("case_id")).alias("labels"), F.struct(iso(start).alias("gap_start"), iso(end).alias("gap_end"), minutes.alias("gap_minutes")).alias("dfir"), observer,
    ))
    return timeline.select(F.when(_is_gap(timeline), gap).otherwise(event).alias("value"))


def _extension(fields: list[tuple[str, Column]]) -> Column:
    parts = F.array(*(F.when(v.cast("string") != "", F.concat(F.lit(f"{k}="), escape_cef_extension(v.cast("string")))) for k, v in fields))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")


def _cef(signature: Column, name: Column, severity: Column, fields: list[tuple[str, Column]], vendor: str, product: str, version: str) -> Column:
    head = [F.lit("CEF:0"), *(escape_cef_header(F.lit(x)) for x in (vendor, product, version)), escape_cef_header(signature), escape_cef_header(name), lookup(F.lower(severity), T.CEF_SEVERITY, 1).cast("string")]
    return F.concat_ws("|", *head, _extension(fields))


def cef_lines(timeline: DataFrame, *, case_id: str, vendor: str, product: str, version: str) -> DataFrame:
    """One line a row."""
    action, category = F.coalesce(F.nullif("action", F.lit("")), F.lit("timeline_event")), F.coalesce("category", F.lit("unknown"))
    ip, host = is_ip(F.col("actor")), F.col("target")
    meta = F.when(F.size(_column(timeline, "metadata", "map<string,string>")) > 0, F.to_json(_column(timeline, "metadata", "map<string,string>")))
    fields = [("deviceExternalId", F.lit(case_id)), ("cat", category), ("act", action), ("fname", F.col("source")), ("msg", F.col("raw")), ("rt", F.unix_millis("ts")), ("suser", F.when(~ip, F.col("actor"))), ("src", F.when(ip, F.col("actor"))), ("dhost", host), ("cs1Label", F.when(meta.isNotNull(), "dfirMetadata")), ("cs1", meta)]
    event = _cef(action, F.concat_ws(":", category, action), F.coalesce("severity", F.lit("info")), fields, vendor, product, version)
    start, end, minutes = _column(timeline, "start", "timestamp"), _column(timeline, "end", "timestamp"), _column(timeline, "duration_min", "double")
    silent = [("deviceExternalId", F.lit(case_id)), ("rt", F.unix_millis(end)), ("cat", F.lit("timeline_gap")), ("act", F.lit("timeline_gap")), ("msg", F.lit(REASON)), ("cn1Label", F.lit("gapMinutes")), ("cn1", minutes), ("cs1Label", F.lit("gapStart")), ("cs1", iso(start)), ("cs2Label", F.lit("gapEnd")), ("cs2", iso(end))]
    gap = _cef(F.lit("timeline_gap"), F.lit("Timeline Gap"), F.lit("low"), silent, vendor, product, version)
    return timeline.select(F.when(_is_gap(timeline), gap).otherwise(event).alias("value"))


def csv_rows(timeline: DataFrame) -> DataFrame:
    """Thirteen fixed columns, safe for spreadsheets."""
    gap = _is_gap(timeline)
    cells = {"timestamp": iso(F.col("ts")), **{c: F.col("source" if c == "source_file" else c) for c in ("severity", "category", "actor", "target", "action", "source_file", "raw")}, "metadata": F.coalesce(F.to_json(_column(timeline, "metadata", "map<string,string>")), F.lit("{}"))}
    rest = {"gap_start": iso(_column(timeline, "start", "timestamp")), "gap_end": iso(_column(timeline, "end", "timestamp")), "duration_minutes": _column(timeline, "duration_min", "double").cast("string")}
    return timeline.select(F.when(gap, "gap").otherwise("event").alias("entry_type"), *(F.when(~gap, formula_safe(v)).alias(k) for k, v in cells.items()), *(F.when(gap, v).alias(k) for k, v in rest.items()))


def all_columns_csv(events: DataFrame) -> DataFrame:
    """Every column by name, nested ones as JSON, times as ISO text."""
    kinds = dict(events.dtypes)
    return events.select(*((F.to_json(c) if kinds[c].startswith(("map", "array", "struct")) else iso(F.col(c)) if kinds[c].startswith("timestamp") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in sorted(events.columns)))


def timesketch(events: DataFrame, *, parser: str) -> DataFrame:
    """The ten fields that timeline tools expect, then the others of the event."""

    def of(*names: str, default: str = "") -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in events.columns]
        return F.coalesce(*found, F.lit(default))

    own = {"datetime": iso(F.col("ts")), "timestamp_desc": F.lit("event"), "message": of("message", "description", "summary", "event"), "parser": F.lit(parser), "source": of("source", default="timeline"), "severity": of("severity"), "category": of("category"), "hostname": of("hostname", "host"), "user": of("user", "target_user"), "attack_tags": attack_tags(events)}
    return events.select(*(v.alias(k) for k, v in own.items()), *(F.col(c) for c in events.columns if c not in own))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_table(rows: DataFrame, path: str, *, partition: str = "case_id") -> None:
    rows.write.partitionBy(partition).parquet(path) if partition in rows.columns else rows.write.parquet(path)


def run(events: DataFrame, path: str, form: str, *, severity: str | None = None, category: str | None = None, since=None, until=None, attack_only: bool = False, parser: str = "tracewright") -> None:
    """Filters, then writes one of jsonl, csv and timesketch."""
    events = between(events, since, until)
    events = equal_text(events, "severity", severity) if severity else events
    events = equal_text(events, "category", category) if category else events
    events = events.where(F.size(attack_tags(events)) > 0) if attack_only else events
    if form == "csv":
        write_csv(all_columns_csv(events), path)
    elif form == "jsonl":
        write_lines(json_lines(events), path)
    elif form == "timesketch":
        timesketch(events, parser=parser).write.json(path)
    else:
        raise ValueError(f"no such form: {form}")
