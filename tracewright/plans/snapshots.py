"""Queries over snapshots, logs, records and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import entropy, formula_safe, internal, is_ip
from tracewright.operators import checks, export, records, timeline
from tracewright.plans import parsed
from tracewright.plans.derived import duck, view
from tracewright.plans.events import tl
from tracewright.sources import logs, windows
from tracewright.sources.records import exploded

P, N, R, M = (f"WITH t AS ({duck(n)})" for n in ("processes", "connections", "registry", "memory"))
A, TL, AL = (f"WITH t AS ({duck(n)})" for n in ("artifacts", "timeline", "auth_lines"))


def names(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def fired(table: str, rules: dict[str, tuple[str, str]], pid: str, name: str) -> str:
    """One SELECT a check; weights and severities from the table of checks."""
    parts = []
    for check, (when, evidence, *severity) in rules.items():
        known, weight = T.CHECKS[check]
        parts.append(f"SELECT subject, {pid} pid, {name} process_name, '{check}' check_id, {severity[0] if severity else repr(known)} severity, CAST({weight} AS BIGINT) weight, CAST({evidence} AS VARCHAR) evidence FROM {table} WHERE {when}")
    return " UNION ALL ".join(parts)


PAIR = " OR ".join(f"(lower(parent_name) = '{p}' AND lower(name) IN {names(c)})" for p, c in T.PARENT_CHILDREN.items())
TOOL = "CASE " + " ".join(f"WHEN contains(lower(name), '{t}') OR contains(lower(cmdline), '{t}') THEN '{t}'" for t in sorted(T.ATTACK_TOOLS)) + " END"
PROCESS = fired("t", {
    "PT-001": (PAIR, "concat(parent_name, ' > ', name)"), "PT-002": (f"lower(name) IN {names(T.SYSTEM_PROCESSES)} AND path <> '' AND NOT contains(lower(path), 'system32')", "path"), "PT-003": (f"lower(name) IN {names(T.LOLBINS)}", "cmdline"),
    "PT-004": (f"lower(name) IN {names(T.WINDOWS_SHELLS)} AND lower(parent_name) IN {names(T.SERVICE_PARENTS)}", "concat(parent_name, ' > ', name)"), "PT-005": (f"lower(name) IN {names(T.WINDOWS_SHELLS)} AND trim(lower(cmdline)) IN ('', lower(name))", "cmdline"),
    "PT-006": ("child_count > 20", "child_count"), "PT-007": (f"{TOOL} IS NOT NULL", TOOL),
}, "pid", "name")
ENTROPY = "(SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) c, max(length(hostname)) n FROM (SELECT unnest(string_split(hostname, '')) ch) GROUP BY ch))"
INTERNAL = "(remote_addr IN ('10.0.0.5', '172.16.3.4', '[fd00::1]', '::ffff:192.168.1.25'))"
WHERE = "concat(remote_addr, ':', remote_port)"
CONNECTION = f"""SELECT subject, pid, process_name, 'NC-003' check_id, 'HIGH' severity, CAST(35 AS BIGINT) weight, hostname evidence FROM t JOIN (SELECT hostname, -sum(c / n * log2(c / n)) b FROM (SELECT hostname, ch, count(*) c, max(length(hostname)) n FROM (SELECT hostname, unnest(string_split(hostname, '')) ch FROM (SELECT DISTINCT hostname FROM t WHERE length(hostname) > 20)) GROUP BY 1, 2) GROUP BY 1) USING (hostname) WHERE b > 3.5
UNION ALL SELECT subject, pid, process_name, 'NC-002', 'HIGH', 30, concat(count(*), ' connections') FROM t WHERE state = 'ESTABLISHED' GROUP BY 1, 2, 3 HAVING count(*) > 20
UNION ALL SELECT subject, pid, process_name, 'NC-006', 'MEDIUM', 20, concat(array_to_string(list_sort(list(DISTINCT local_port))[1:10], ', '), CASE WHEN count(DISTINCT local_port) > 10 THEN concat(' (+', count(DISTINCT local_port) - 10, ' more)') ELSE '' END) FROM t WHERE state = 'LISTEN' GROUP BY 1, 2, 3 HAVING count(*) > 5
UNION ALL """ + fired("t", {"NC-001": (f"remote_port IN {names(T.SUSPICIOUS_PORTS)}", WHERE), "NC-004": (f"remote_port IN {names(T.MINING_PORTS)}", WHERE), "NC-005": (f"remote_port IN {names(T.TOR_PORTS)}", WHERE), "NC-007": (f"state = 'ESTABLISHED' AND remote_port IN {names(T.ADMIN_PORTS)} AND {INTERNAL}", WHERE)}, "pid", "process_name")
ODD = "(value LIKE '%Users%')"
GRADE = f"CASE WHEN {ODD} THEN 'HIGH' ELSE 'MEDIUM' END"
REGISTRY = fired("t", {
    "REG-P-001": (f"kind = 'run_keys' AND {ODD}", "value", GRADE), "REG-P-002": (f"kind = 'run_services' AND {ODD}", "value", GRADE), "REG-P-003": ("kind = 'startup_files'", "path"), "REG-P-004": ("kind = 'services' AND starts_with(image_path, '%TEMP%')", "image_path", "'CRITICAL'"),
    "REG-P-005": ("kind = 'ifeo_entries' AND debugger <> ''", "debugger"), "REG-P-006": ("kind = 'appinit_dlls' AND value <> ''", "value"), "REG-P-007": ("kind = 'winlogon_entries' AND (key = 'Taskman' OR key = 'Shell' AND value <> 'explorer.exe')", "value"),
}, "CAST(NULL AS BIGINT)", "name")
BASE = "regexp_extract(rtrim(exe, ' (deleted)'), '[^/]*$')"
MEMORY = " UNION ALL ".join([fired("x", {
    "MA-001": ("path = ''", "span"), "MA-002": ("ends_with(path, ' (deleted)')", "path"), "MA-003": (parsed.STAGED, "path"), "MA-007": (f"base <> '' AND bits >= {checks.BITS}", "path"),
}, "pid", "comm"), fired("(SELECT * FROM t WHERE accessible)", {
    "MA-004": (f"{BASE} <> '' AND NOT contains({BASE}, comm) AND NOT contains(comm, {BASE})", f"concat(comm, ' / ', {BASE})"), "MA-005": (f"lower(parent_comm) IN {names(T.SERVER_PARENTS)} AND comm IN {names(T.UNIX_SHELLS)}", "concat(parent_comm, ' > ', comm)"),
    "MA-006": ("contains(exe, '(deleted)')", "exe"),
}, "pid", "comm")])
WEIGHTS = ", ".join(f"('{c}', {w})" for c, (_, w) in T.CHECKS.items())
SCORE = "SELECT subject, CAST(least(100, sum(weight)) AS BIGINT) risk_score, CAST(sum(n) AS BIGINT) findings, count(*) checks FROM (SELECT subject, check_id, any_value(weight) weight, count(*) n FROM f GROUP BY 1, 2) GROUP BY 1"


def finding(df):
    return df.select("subject", "pid", "process_name", "check_id", "severity", F.col("weight").cast("long").alias("weight"), "evidence")


def auth_lines(s, d):
    """Lines of an auth log, two kinds in five of no interest."""
    head = F.concat(F.date_format("t", "MMM "), F.lpad(F.dayofmonth("t").cast("string"), 2, " "), F.date_format("t", " HH:mm:ss "), F.col("h"))
    tail = F.when(F.col("kind") == 0, F.concat(F.lit(" sshd[12]: Failed password for invalid user "), "u", F.lit(" from "), "ip", F.lit(" port 22 ssh2"))).when(F.col("kind") == 1, F.concat(F.lit(" sshd[7]: Accepted publickey for "), "u", F.lit(" from "), "ip")).when(F.col("kind") == 2, F.concat(F.lit(" sudo: "), "u", F.lit(" : TTY=pts/0 ; USER=root ; COMMAND=/bin/run "), F.col("k").cast("string"))).otherwise(" kernel: up")
    # explode keeps the text in one place; else each use of a line would build it again
    return view(s, d, "auth_lines").select(F.explode(F.array(F.concat(head, tail))).alias("line"), F.lit("auth.log").alias("source"))


def mac_lines(s, d):
    head = F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("seq") % 2 == 0, "Z").otherwise("-0300"))
    tail = F.when(F.col("kind") == 0, F.concat(F.lit(" authd: authentication FAILED for user "), "u", F.lit(" from "), "ip")).when(F.col("kind") == 1, F.concat(F.lit(" authd: Authenticated user "), "u")).when(F.col("kind") == 2, F.concat(F.lit(" sudo[3]: "), "u", F.lit(" : TTY=x ; USER=root ; COMMAND=/bin/ls "))).when(F.col("kind") == 3, F.lit(" launchd: bootout /Library/LaunchDaemons/a.plist")).otherwise(" nothing")
    return view(s, d, "auth_lines").select(F.explode(F.array(F.concat(head, tail))).alias("line"), F.lit("mac.log").alias("source"))


def windows_rows(s, d):
    value = lambda n, v: F.struct(F.lit(n).alias("_Name"), v.alias("_VALUE"))
    eid = F.element_at(F.array(*map(F.lit, ("4624", "4625", "4728", "7045", "999"))), (F.col("kind") + 1).cast("int"))
    rows = view(s, d, "auth_lines")
    return rows.select(F.struct(eid.alias("EventID"), F.struct(F.when(F.col("seq") % 7 != 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("_SystemTime")).alias("TimeCreated")).alias("System"), F.struct(F.array(value("IpAddress", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("ip"))), value("WorkstationName", F.lit("ws")), value("TargetUserName", F.col("u")), value("SubjectUserName", F.lit("adm")), value("MemberName", F.col("h")), value("ServiceName", F.lit("svc"))).alias("Data")).alias("EventData"), F.lit("x.xml").alias("source"))


def exported(s, d):
    return tl(s, d).withColumn("metadata", F.create_map(F.lit("host"), F.col("host")))


def ecs_counts(s, d):
    """ECS documents counted by what they say; gaps are counted also where there are none."""
    lines = export.ecs_lines(timeline.interleaved(exported(s, d).drop("start", "end"), threshold_min=60), case_id="c1", product="p")
    of = lambda path: F.coalesce(F.get_json_object("value", path), F.lit("-"))
    told = lines.select(F.get_json_object("value", "$.event.action").alias("action"), F.get_json_object("value", "$.event.kind").alias("kind"), of("$.event.severity").alias("severity"), of("$.source.ip").alias("ip"), of("$.related.hosts[0]").alias("related"), F.lit(1).alias("n"))
    none = s.range(1).select(F.lit("timeline_gap").alias("action"), F.lit("state").alias("kind"), *(F.lit("-").alias(c) for c in ("severity", "ip", "related")), F.lit(0).alias("n"))
    return told.unionByName(none).groupBy("action", "kind", "severity", "ip", "related").agg(F.sum("n").alias("n"))


def files(s, d, *, changed: bool):
    """Documents as evidence files; of the changed ones every hundredth differs and every 150th is gone."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    content = F.when(F.lit(changed) & (F.col("doc_id") % 100 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    docs = docs.where(F.col("doc_id") % 150 != 0) if changed else docs
    return docs.select("path", F.sha2(content, 256).alias("sha256"))


QUERIES = {
    "process_findings": (lambda s, d: finding(checks.process_findings(view(s, d, "processes"))), f"{P} {PROCESS}"),
    "process_scores": (lambda s, d: checks.minimum_score(checks.scores(checks.process_findings(view(s, d, "processes"))), 50), f"{P}, f AS ({PROCESS}) SELECT * FROM ({SCORE}) WHERE risk_score >= 50"),
    "process_by_severity": (lambda s, d: checks.by_severity(checks.process_findings(view(s, d, "processes"))), f"{P}, f AS ({PROCESS}) SELECT check_id, " + ", ".join(f"count(*) FILTER (severity = '{x}') \"{x}\"" for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " FROM f GROUP BY 1"),
    "child_counts": (lambda s, d: checks.with_child_count(view(s, d, "processes").drop("child_count").withColumn("subject", F.lit("all"))).select("pid", F.col("child_count").cast("long").alias("child_count")), f"{P} SELECT pid, (SELECT count(*) FROM t c WHERE c.ppid = t.pid) child_count FROM t"),
    "connection_findings": (lambda s, d: finding(checks.connection_findings(view(s, d, "connections"))), f"{N} {CONNECTION}"),
    "connection_scores": (lambda s, d: checks.scores(checks.connection_findings(view(s, d, "connections"))), f"{N}, f AS ({CONNECTION}) {SCORE}"),
    "internal_addresses": (lambda s, d: view(s, d, "connections").groupBy("remote_addr").agg(F.bool_or(internal(F.col("remote_addr"))).alias("internal"), F.bool_or(is_ip(F.col("remote_addr"))).alias("is_ip"), F.count("*").alias("n")), f"{N} SELECT remote_addr, {INTERNAL} internal, NOT starts_with(remote_addr, '[') is_ip, count(*) n FROM t GROUP BY 1"),
    "name_entropy": (lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(entropy(F.col("p_name")), 6).alias("bits")), "SELECT p_partkey, round(-sum(c / n * log2(c / n)), 6) bits FROM (SELECT p_partkey, ch, count(*) c, max(n) n FROM (SELECT p_partkey, length(p_name) n, unnest(string_split(p_name, '')) ch FROM part) GROUP BY 1, 2) GROUP BY 1"),
    "script_risk": (lambda s, d: checks.script_risk(checks.script_checks(view(s, d, "scripts"))).select("artifact_id", F.array_join("checks.check_id", ",").alias("checks"), F.col("risk_score").cast("long").alias("risk_score"), "threat_level"), parsed.SCRIPT_RISK),
    "script_scan_of_documents": (lambda s, d: checks.script_checks(s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("command_text"))).select("doc_id", F.array_join("checks.check_id", ",").alias("checks")), f"SELECT doc_id, {parsed.scan('text')} checks FROM documents"),
    "registry_findings": (lambda s, d: finding(checks.registry_findings(view(s, d, "registry"))).drop("pid"), f"{R} SELECT subject, process_name, check_id, severity, weight, evidence FROM ({REGISTRY})"),
    "memory_findings": (lambda s, d: finding(checks.memory_findings(view(s, d, "memory"))), f"{M}, x AS ({parsed.EXECUTABLE}) {MEMORY}"),
    "memory_maps": (lambda s, d: checks.map_rows(view(s, d, "memory")).groupBy("perms", "path").agg(F.count("*").alias("n")), f"SELECT perms, path, count(*) n FROM ({parsed.MAPS}) GROUP BY 1, 2"),
    "parent_names": (lambda s, d: checks.with_parent_name(view(s, d, "memory").withColumn("subject", F.lit("all"))).select("pid", F.coalesce("parent_comm", F.lit("-")).alias("parent")), f"{M} SELECT t.pid, coalesce(p.comm, '-') parent FROM t LEFT JOIN t p ON p.pid = t.ppid"),
    "container_context": (lambda s, d: records.security_context(c := view(s, d, "containers")).join(records.container_identity(c), "container_id").select("container_id", "privileged", F.array_join("cap_add", ",").alias("cap_add"), "network_mode", "user", F.coalesce("image", F.lit("-")).alias("image"), "running"), parsed.CONTEXT),
    "container_env": (lambda s, d: records.masked_env(view(s, d, "containers")).select("container_id", F.array_join("env", ";").alias("env")), parsed.ENV),
    "container_mounts": (lambda s, d: records.mounts(view(s, d, "containers")).select("container_id", "source", "destination", "rw"), parsed.MOUNTS),
    "artifact_summary": (lambda s, d: records.artifact_summary(view(s, d, "artifacts")), f"{A} SELECT container_id, CAST(sum(size_bytes) AS BIGINT) total_bytes, count(*) FILTER (coalesce(error, '') = '') succeeded, count(*) FILTER (coalesce(error, '') <> '') failed FROM t GROUP BY 1"),
    "first_artifacts": (lambda s, d: records.first_artifact(view(s, d, "artifacts"), "type1"), f"{A} SELECT container_id, arg_min(content, seq) content FROM t WHERE artifact_type = 'type1' GROUP BY 1"),
    "rejected_artifacts": (lambda s, d: records.rejects(view(s, d, "artifacts"), ("seq", "error", "host")).groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n")), f"{A} SELECT CASE WHEN error IS NULL THEN 'error,host' ELSE 'host' END missing, count(*) n FROM t GROUP BY 1"),
    "valid_case_ids": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", records.valid_case_id(F.col("source")).alias("ok")), "SELECT doc_id, coalesce(trim(source) NOT IN ('', '.', '..') AND NOT contains(source, '/') AND NOT contains(source, chr(92)), false) ok FROM documents"),
    "valid_whole_case_ids": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", records.valid_case_id(F.col("text")).alias("ok")), "SELECT doc_id, coalesce(trim(text) NOT IN ('', '.', '..') AND NOT contains(text, '/') AND NOT contains(text, chr(92)), false) ok FROM documents"),
    "manifest_mismatches": (lambda s, d: records.manifest_mismatches(files(s, d, changed=False), files(s, d, changed=True)).select("path", F.coalesce("actual", F.lit("-")).alias("actual")), "SELECT concat('doc/', doc_id) path, CASE WHEN doc_id % 150 = 0 THEN '-' ELSE sha256(concat(text, '!')) END actual FROM documents WHERE doc_id % 150 = 0 OR doc_id % 100 = 0"),
    "auth_log_events": (lambda s, d: logs.auth_events(auth_lines(s, d), year=2024).select(F.unix_seconds("ts").alias("at"), "host", "category", "severity", "actor", "target", "action", F.coalesce(F.col("metadata")["src_port"], F.lit("")).alias("port"), F.coalesce(F.col("metadata")["command"], F.lit("")).alias("command")), parsed.AUTH),
    "mac_log_events": (lambda s, d: logs.mac_events(mac_lines(s, d)).select(F.unix_seconds("ts").alias("at"), "category", "severity", F.coalesce("actor", F.lit("-")).alias("actor"), "target", "action"), parsed.MAC),
    "windows_events": (lambda s, d: windows.windows_events(windows_rows(s, d)).select(F.unix_seconds("ts").alias("at"), "category", "severity", F.coalesce("actor", F.lit("-")).alias("actor"), F.coalesce("target", F.lit("-")).alias("target"), "action"), f"""{AL} SELECT CAST(epoch(date_trunc('second', t)) AS BIGINT) AS at, CASE kind WHEN 0 THEN 'authentication' WHEN 1 THEN 'authentication' WHEN 2 THEN 'privilege_escalation' ELSE 'system' END category, CASE kind WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 4 THEN 'info' ELSE 'high' END severity,
CASE WHEN kind < 2 THEN CASE WHEN seq % 3 = 0 THEN 'ws' ELSE ip END WHEN kind = 2 THEN 'adm' ELSE '-' END actor, CASE WHEN kind < 2 THEN u WHEN kind = 2 THEN h WHEN kind = 3 THEN 'svc' ELSE '-' END target, CASE kind WHEN 0 THEN 'windows_logon_success' WHEN 1 THEN 'windows_logon_failure' WHEN 2 THEN 'windows_group_member_added_global' WHEN 3 THEN 'windows_service_installed' ELSE 'windows_event_999' END action FROM t WHERE seq % 7 <> 0"""),
    "export_cef": (lambda s, d: export.cef_lines(tl(s, d), case_id="c=1", vendor="acme", product="pro|duct", version="1"), f"""{TL} SELECT concat('CEF:0|acme|pro', chr(92), '|duct|1|', action, '|', category, ':', action, '|', CASE severity WHEN 'low' THEN 3 WHEN 'medium' THEN 6 WHEN 'high' THEN 8 ELSE 1 END, '|deviceExternalId=c', chr(92), '=1 cat=', category, ' act=', action, ' fname=', source, ' msg=', replace(raw, '=', concat(chr(92), '=')), ' rt=', epoch_us(ts) // 1000, CASE WHEN starts_with(actor, 'user') THEN ' suser=' ELSE ' src=' END, actor, ' dhost=', target) AS value FROM t"""),
    "export_ecs": (ecs_counts, f"""{TL}, l AS (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY ts, source, action) p FROM t) SELECT action, 'event' kind, CASE severity WHEN 'low' THEN '21' WHEN 'medium' THEN '47' WHEN 'high' THEN '73' ELSE '1' END severity, CASE WHEN starts_with(actor, '10.') THEN actor ELSE '-' END ip, host related, count(*) n FROM t GROUP BY ALL UNION ALL SELECT 'timeline_gap', 'state', '-', '-', '-', count(*) FROM l WHERE epoch_us(ts) - p > 3600000000"""),
    "export_csv": (lambda s, d: export.csv_rows(tl(s, d)).select("timestamp", "severity", "actor", "source_file", "raw", "metadata"), f"{TL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, severity, actor, source source_file, concat(chr(39), raw) raw, '{{}}' metadata FROM t"),
    "export_timesketch": (lambda s, d: export.timesketch(tl(s, d).withColumn("tags", F.concat_ws(" , ", "action", "severity", "action")), parser="tw").select("datetime", "source", "hostname", F.array_join("attack_tags", ";").alias("tags"), "seq"), f"{TL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS datetime, source, host hostname, concat(action, ';', severity) tags, seq FROM t"),
    "export_jsonl": (lambda s, d: export.json_lines(tl(s, d).select("seq", "case_id", "severity")), f"{TL} SELECT concat('{{\"seq\":', seq, ',\"case_id\":\"', case_id, '\",\"severity\":\"', severity, '\"}}') AS value FROM t"),
    "formula_cells": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(formula_safe(F.concat(F.element_at(F.array(*map(F.lit, (" =", "+", "@", "-", "x"))), (F.col("doc_id") % 5 + 1).cast("int")), F.col("text"))), 256).alias("sha")), "SELECT doc_id, sha256(concat(CASE WHEN doc_id % 5 < 4 THEN chr(39) ELSE '' END, CASE doc_id % 5 WHEN 0 THEN ' =' WHEN 1 THEN '+' WHEN 2 THEN '@' WHEN 3 THEN '-' ELSE 'x' END, text)) sha FROM documents"),
    "observations": (lambda s, d: exploded(s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("case"), (F.col("c_custkey") % 9).cast("string")).alias("case_id"), F.lit("t").alias("collected_at"), F.lit("macos").alias("platform"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("observations"))).groupBy("case_id", "key").agg(F.count("*").alias("n"), F.max("value").alias("last")), "SELECT concat('case', c_custkey % 9) case_id, 'name' AS key, count(*) n, max(c_name) AS last FROM customer GROUP BY 1 UNION ALL SELECT concat('case', c_custkey % 9), 'segment', count(*), max(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1"),
    "auth_user_filter": (lambda s, d: logs.of_user(logs.auth_events(auth_lines(s, d), year=2024), "user7").groupBy("action").agg(F.count("*").alias("n")), f"SELECT action, count(*) n FROM ({parsed.AUTH}) WHERE target = 'user7' OR action = 'sudo_command' AND actor = 'user7' GROUP BY 1"),
    "attack_only": (lambda s, d: (lambda r: r.where(F.size(records.attack_tags(r)) > 0).select("seq"))(tl(s, d).withColumn("mitre_attack", F.when(F.col("seq") % 3 == 0, " , ").when(F.col("seq") % 3 == 1, "T1, T2"))), f"{TL} SELECT seq FROM t WHERE seq % 3 = 1"),
    "finding_lookup": (lambda s, d: checks.select_findings(checks.process_findings(view(s, d, "processes")), check="PT-007", process="MIMIKATZ.exe").select("subject", "pid"), f"{P} SELECT subject, pid FROM t WHERE name = 'Mimikatz.exe'"),
    "integrity": (lambda s, d: records.verified(files(s, d, changed=False), files(s, d, changed=True)), "SELECT count(*) = 0 ok, count(*) mismatches FROM documents WHERE doc_id % 150 = 0 OR doc_id % 100 = 0"),
}
