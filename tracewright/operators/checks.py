"""Rule checks over snapshot tables: one scan gives all findings of a table.

Findings: subject, pid, process_name, check_id, severity, weight, evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import basename, entropy, first_match, internal, without_deleted

OUTBOUND, LISTENERS, CHILDREN, HOSTNAME, BITS = 20, 5, 20, 20, 3.5
FINDING = ["subject", "pid", "process_name", "check_id", "severity", "weight", "evidence"]


def text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def low(column: str) -> Column:
    return F.lower(text(column))


def _finding(check: str, when: Column, evidence: Column, severity: Column | None = None) -> Column:
    known, weight = T.CHECKS[check]
    row = F.struct(F.lit(check).alias("check_id"), (F.lit(known) if severity is None else severity).alias("severity"), F.lit(weight).alias("weight"), evidence.cast("string").alias("evidence"))
    return F.when(F.coalesce(when, F.lit(False)), row)


def _findings(table: DataFrame, checks: list[Column], pid: Column, name: Column) -> DataFrame:
    fired = F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull()))
    return table.select(F.col("subject"), pid.alias("pid"), name.alias("process_name"), fired.alias("f")).select("subject", "pid", "process_name", "f.*")


def one_of(column: Column, names: list) -> Column:
    return column.isin(names)


def pair(parent: Column, child: Column) -> Column:
    table = F.create_map(*(x for p, cs in T.PARENT_CHILDREN.items() for x in (F.lit(p), F.array(*map(F.lit, cs)))))
    return F.coalesce(F.array_contains(table[parent], child), F.lit(False))


def with_child_count(processes: DataFrame) -> DataFrame:
    """child_count from ppid, where the snapshot has none."""
    own = processes.groupBy("subject", F.col("ppid").alias("pid")).agg(F.count("*").cast("int").alias("children"))
    return processes.join(own, ["subject", "pid"], "left").withColumn("child_count", F.coalesce(*([F.col("child_count")] if "child_count" in processes.columns else []), "children", F.lit(0))).drop("children")


def with_parent_name(snapshots: DataFrame) -> DataFrame:
    """parent_comm of each process from the same subject."""
    parents = snapshots.select("subject", F.col("pid").alias("ppid"), F.col("comm").alias("parent_comm")).dropDuplicates(["subject", "ppid"])
    return snapshots.drop("parent_comm").join(parents, ["subject", "ppid"], "left")


def mixed_enough(name: Column) -> Column:
    """Whether a text has so many letters that its entropy can exceed BITS at all; counted before the shares are."""
    return F.size(F.array_distinct(F.split(name, ""))) > 2**BITS


def process_findings(processes: DataFrame, *, children: int = CHILDREN) -> DataFrame:
    """subject, pid, name, cmdline, parent_name, path, child_count -> PT-001 to PT-007."""
    name, parent, line = low("name"), low("parent_name"), low("cmdline")
    tool = F.get(F.filter(F.array(*map(F.lit, sorted(T.ATTACK_TOOLS))), lambda t: name.contains(t) | line.contains(t)), 0)
    quiet = F.trim(line)
    return _findings(processes, [
        _finding("PT-001", pair(parent, name), F.concat_ws(" > ", "parent_name", "name")),
        _finding("PT-002", one_of(name, T.SYSTEM_PROCESSES) & (text("path") != "") & ~low("path").contains("system32"), F.col("path")),
        _finding("PT-003", one_of(name, T.LOLBINS), F.col("cmdline")),
        _finding("PT-004", one_of(name, T.WINDOWS_SHELLS) & one_of(parent, T.SERVICE_PARENTS), F.concat_ws(" > ", "parent_name", "name")),
        _finding("PT-005", one_of(name, T.WINDOWS_SHELLS) & ((quiet == "") | (quiet == name)), F.col("cmdline")),
        _finding("PT-006", F.col("child_count") > children, F.col("child_count")),
        _finding("PT-007", tool.isNotNull(), tool),
    ], F.col("pid"), F.col("name"))


def connection_findings(connections: DataFrame, *, outbound: int = OUTBOUND, listeners: int = LISTENERS, lateral: bool = True) -> DataFrame:
    """Row checks NC-001, 003, 004, 005, 007 in one scan, and per process NC-002 and NC-006."""
    port, host = F.col("remote_port"), text("hostname")
    where = F.concat_ws(":", "remote_addr", port.cast("string"))
    established = F.upper(text("state")) == "ESTABLISHED"
    rows = _findings(connections, [
        _finding("NC-001", one_of(port, T.SUSPICIOUS_PORTS), where),
        _finding("NC-003", F.when(F.length(host) > HOSTNAME, mixed_enough(host) & (entropy(host) > BITS)).otherwise(False), host),
        _finding("NC-004", one_of(port, T.MINING_PORTS), where),
        _finding("NC-005", one_of(port, T.TOR_PORTS), where),
        _finding("NC-007", established & one_of(port, T.ADMIN_PORTS) & internal(F.col("remote_addr")) & F.lit(lateral), where),
    ], F.col("pid"), F.col("process_name"))
    return rows.unionByName(process_totals(connections, outbound=outbound, listeners=listeners))


def process_totals(connections: DataFrame, *, outbound: int = OUTBOUND, listeners: int = LISTENERS) -> DataFrame:
    """NC-002 and NC-006 in one aggregation: processes with many connections, and with many listening ports, the first ten shown."""
    state = F.upper(text("state"))
    listen = state == "LISTEN"
    n = connections.where(state.isin("ESTABLISHED", "LISTEN")).groupBy("subject", "pid", "process_name").agg(F.count_if(~listen).alias("out"), F.count_if(listen).alias("listening"), F.array_sort(F.collect_set(F.when(listen, F.col("local_port")))).alias("ports"))
    more = F.when(F.size("ports") > 10, F.concat(F.lit(" (+"), (F.size("ports") - 10).cast("string"), F.lit(" more)"))).otherwise("")
    shown = F.concat(F.array_join(F.transform(F.slice("ports", 1, 10), lambda p: p.cast("string")), ", "), more)
    return _findings(n, [
        _finding("NC-002", F.col("out") > outbound, F.concat(F.col("out").cast("string"), F.lit(" connections"))),
        _finding("NC-006", F.col("listening") > listeners, shown),
    ], F.col("pid"), F.col("process_name"))


def script_checks(scripts: DataFrame) -> DataFrame:
    """artifact_id and checks (array of check_id, severity, weight, technique, evidence) of command_text."""
    t = text("command_text")
    fired = {k: t.rlike(p) for k, p in T.SCRIPT_PATTERNS.items()}
    evidence = {k: first_match(t, p) for k, p in T.SCRIPT_PATTERNS.items()}
    fired["PSA-003"] = t.rlike(T.SCRIPT_RUNS) & t.rlike(T.SCRIPT_LOADS)
    evidence["PSA-003"] = F.concat(first_match(t, T.SCRIPT_RUNS), F.lit(" ... "), first_match(t, T.SCRIPT_LOADS))
    joins = F.regexp_count(t, F.lit(T.SCRIPT_JOIN_DOUBLE)) + F.regexp_count(t, F.lit(T.SCRIPT_JOIN_SINGLE))
    fired["PSA-006"] = t.rlike(T.SCRIPT_TICK) | t.rlike(T.SCRIPT_CHARS) | (joins >= 3)
    evidence["PSA-006"] = F.coalesce(*(F.nullif(first_match(t, p), F.lit("")) for p in (T.SCRIPT_TICK, T.SCRIPT_CHARS, T.SCRIPT_JOIN_DOUBLE, T.SCRIPT_JOIN_SINGLE)), F.lit(""))
    rows = []
    for check in sorted(fired):
        severity, weight = T.CHECKS[check]
        rows.append(F.when(fired[check], F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"), F.lit(T.SCRIPT_TECHNIQUES[check]).alias("technique"), evidence[check].alias("evidence"))))
    return scripts.withColumn("checks", F.filter(F.array(*rows), lambda c: c.isNotNull()))


def script_risk(scripts: DataFrame) -> DataFrame:
    """Adds risk_score, threat_level and techniques to ``script_checks``."""
    score = F.least(F.lit(100), F.aggregate("checks", F.lit(0), lambda a, c: a + c["weight"]))
    level = None
    for least, name in T.THREAT_LEVELS:
        level = F.when(score >= least, name) if level is None else level.when(score >= least, name)
    return scripts.withColumn("risk_score", score).withColumn("threat_level", level).withColumn("techniques", F.transform("checks", lambda c: c["technique"]))


def registry_findings(entries: DataFrame, *, all_run: bool = False, all_services: bool = False) -> DataFrame:
    """subject, kind, hive, name, value, path, image_path, image, debugger, key -> REG-P-001 to REG-P-007."""
    kind, value = F.col("kind"), text("value")
    odd = value.rlike(T.WRITABLE_PATH)
    run = odd | F.lit(all_run)
    graded = F.when(odd, "HIGH").otherwise("MEDIUM")
    service = text("image_path").rlike(T.WRITABLE_PATH)
    key = low("key")
    safe = F.create_map(*(F.lit(x) for p in T.WINLOGON_SAFE.items() for x in p))[key]
    hijack = safe.isNotNull() & ((safe == "") | (F.trim(F.lower(value)) != F.lower(safe)))
    found = _findings(entries, [
        _finding("REG-P-001", (kind == "run_keys") & run, value, graded),
        _finding("REG-P-002", (kind == "run_services") & run, value, graded),
        _finding("REG-P-003", kind == "startup_files", F.col("path")),
        _finding("REG-P-004", (kind == "services") & (service | F.lit(all_services)), F.col("image_path"), F.when(F.lit(all_services), "LOW").otherwise("CRITICAL")),
        _finding("REG-P-005", (kind == "ifeo_entries") & (text("debugger") != ""), F.col("debugger")),
        _finding("REG-P-006", (kind == "appinit_dlls") & (value != ""), value),
        _finding("REG-P-007", (kind == "winlogon_entries") & hijack, value),
    ], F.lit(None).cast("long"), F.coalesce("name", "key"))
    return found.withColumn("evidence", F.substring("evidence", 1, 512))


def map_rows(snapshots: DataFrame) -> DataFrame:
    """subject, pid, comm, range, perms, path of each line of maps."""
    lines = snapshots.select("subject", "pid", "comm", F.explode("maps").alias("line"))
    return lines.select("subject", "pid", "comm", *(F.regexp_extract("line", T.MAP_LINE, i + 1).alias(n) for i, n in enumerate(("range", "perms", "path")))).where("range <> ''").withColumn("path", F.trim("path"))


def memory_findings(snapshots: DataFrame) -> DataFrame:
    """subject, pid, comm, exe, parent_comm, maps, accessible -> MA-001 to MA-007; inaccessible ones give none."""
    seen = snapshots.where("accessible")
    mapped = map_rows(seen).where(F.col("perms").contains("x"))
    path = F.col("path")
    base = basename(without_deleted(path))
    staged = F.lit(False)
    for d in T.STAGING_DIRS:
        staged = staged | path.startswith(d)
    rows = _findings(mapped, [
        _finding("MA-001", path == "", F.col("range")),
        _finding("MA-002", path.endswith(" (deleted)"), path),
        _finding("MA-003", staged, path),
        _finding("MA-007", F.when(base != "", entropy(base) >= BITS).otherwise(False), path),
    ], F.col("pid"), F.col("comm"))
    comm, exe = text("comm"), text("exe")
    exe_base = basename(without_deleted(exe))
    own = _findings(seen, [
        _finding("MA-004", (comm != "") & (exe_base != "") & ~exe_base.contains(comm) & ~comm.contains(exe_base), F.concat_ws(" / ", comm, exe_base)),
        _finding("MA-005", one_of(low("parent_comm"), T.SERVER_PARENTS) & one_of(low("comm"), T.UNIX_SHELLS), F.concat_ws(" > ", "parent_comm", "comm")),
        _finding("MA-006", exe.contains("(deleted)"), exe),
    ], F.col("pid"), F.col("comm"))
    return rows.unionByName(own)


def scores(findings: DataFrame) -> DataFrame:
    """Per subject: the weights of distinct checks, 100 at most, and the number of findings."""
    each = findings.groupBy("subject", "check_id").agg(F.first("weight").alias("weight"), F.count("*").alias("n"))
    return each.groupBy("subject").agg(F.least(F.lit(100), F.sum("weight")).cast("long").alias("risk_score"), F.sum("n").alias("findings"), F.count("*").alias("checks"))


def minimum_score(scored: DataFrame, least: int) -> DataFrame:
    return scored.where(F.col("risk_score") >= least)


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings of each check by severity, as columns."""
    return findings.groupBy("check_id").pivot("severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"]).count().na.fill(0)


def select_findings(findings: DataFrame, *, check: str | None = None, pid: int | None = None, process: str | None = None) -> DataFrame:
    findings = findings.where(F.col("check_id") == check) if check is not None else findings
    findings = findings.where(F.col("pid") == pid) if pid is not None else findings
    return findings.where(F.lower("process_name") == process.lower()) if process is not None else findings
