"""Operators on small literal tables: boundaries, missing values, windows."""

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar
from tracewright.operators import attack, checks, correlate, diff, export, movement, records, rules, timeline
from tracewright.sources import logs, records as readers, windows

BASE = datetime(2026, 4, 1, 10)
CORR = "seq long, ts timestamp, source string, event_type string, source_ip string, username string, hostname string"
EVENT = "seq long, case_id string, ts timestamp, source string, host string, category string, severity string, actor string, target string, action string, raw string"


def corr(spark, rows):
    """(offset s or None, type, ip, user) in order of ingestion."""
    return spark.createDataFrame([(i, None if s is None else BASE + timedelta(seconds=s), "x", t, ip, u, "h") for i, (s, t, ip, u) in enumerate(rows)], CORR)


def events(spark, rows):
    """Dicts over defaults."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple({"seq": i, "case_id": "c", "ts": BASE, "severity": "info", "category": "system", "source": "s", "action": "a"} .get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows)], EVENT)


def at(hours):
    return BASE.replace(hour=0) + timedelta(hours=hours)


def test_brute_force_needs_five_failures(spark):
    fails = [(5 * i, "auth_fail", "9.9.9.9", "root") for i in range(10)]
    one = correlate.brute_then_success(corr(spark, [*fails, (60, "auth_success", "9.9.9.9", "root"), (70, "auth_success", "9.9.9.9", "root")])).collect()
    assert [(r.severity, r.confidence, r.event_count, r.seq) for r in one] == [("CRITICAL", 0.7, 11, 10)]
    assert correlate.brute_then_success(corr(spark, [*fails[:2], (60, "auth_success", "9.9.9.9", "root")])).count() == 0
    assert correlate.brute_then_success(corr(spark, [*fails, (700, "auth_success", "9.9.9.9", "root")])).count() == 0
    missing = [(i, "auth_fail", None, "a") for i in range(5)] + [(6, "auth_success", "", "a"), (None, "auth_success", None, "a")]
    assert [r.source_ip for r in correlate.brute_then_success(corr(spark, missing)).collect()] == ["unknown"]


def test_spray_counts_distinct_users(spark):
    spray = [(i, "auth_fail", "1.1.1.1", f"user{i}") for i in range(10)]
    found = correlate.spray_then_pivot(corr(spark, [*spray, (100, "auth_success", "1.1.1.1", "user3")])).collect()
    assert [(r.confidence, r.event_count) for r in found] == [(0.7, 11)]
    same = [(i, "auth_fail", "1.1.1.1", f"user{i % 4}") for i in range(20)]
    assert correlate.spray_then_pivot(corr(spark, [*same, (100, "auth_success", "1.1.1.1", "u")])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(400), rng.choice(["auth_fail", "auth_success", "sudo", "user_add", "net_scan", "exploit"]), rng.choice(["a", "b", ""]), rng.choice(["u", "v", "w", "x", ""])) for _ in range(120)]
    frame, w = corr(spark, rows), 40
    ev = [(i, s, t, ip or "unknown", ip, u) for i, (s, t, ip, u) in enumerate(rows)]
    brute, spray = {}, {}
    for i, s, t, ip, _, _ in ev:
        if t == "auth_success":
            near = [e for e in ev if e[2] == "auth_fail" and e[3] == ip and s - w <= e[1] <= s]
            if len(near) >= 3:
                brute.setdefault(ip, (i, len(near) + 1))
            if len({e[5] for e in near} - {""}) >= 3:
                spray.setdefault(ip, (i, len({e[5] for e in near} - {""}) + 1))
    assert {r.source_ip: (r.seq, r.event_count) for r in correlate.brute_then_success(frame, window_s=w, fails=3).collect()} == brute
    assert {r.source_ip: (r.seq, r.event_count) for r in correlate.spray_then_pivot(frame, window_s=w, users=3).collect()} == spray
    held = {}
    for i, s, t, _, ip, u in ev:
        if t == "auth_success":
            n = sum(e[2] == "user_add" and 0 <= e[1] - s <= w and (u != "" and e[5] == u or ip != "" and e[4] == ip) for e in ev)
            if n:
                held[i] = min(3, n) + 1
    assert {r.seq: r.event_count for r in correlate.persistence(frame, window_s=w).collect()} == held


def test_privilege_recon_and_hours(spark):
    rows = [(0, "auth_success", "a", "alice"), (30, "sudo", "b", "alice"), (31, "sudo", "b", "bob"), (40, "net_scan", "c", ""), (50, "net_scan", "c", ""), (160, "exploit", "c", "")]
    assert [(r.username, r.event_count) for r in correlate.privilege_escalation(corr(spark, rows)).collect()] == [("alice", 2)]
    assert [(r.seq, r.severity) for r in correlate.recon_then_exploit(corr(spark, rows)).collect()] == [(4, "CRITICAL")]
    night = spark.createDataFrame([(0, datetime(2026, 4, 1, 3), "x", "auth_success", "a", "u", "h"), (1, datetime(2026, 4, 1, 9), "x", "auth_success", "a", "u", "h")], CORR)
    assert [r.seq for r in correlate.anomalous_time(night, start_hour=9, end_hour=17).collect()] == [0]
    every = correlate.correlate(corr(spark, rows))
    assert correlate.report(every).collect()[0].incidents == 2
    assert correlate.select_incidents(every, username="alice").count() == 1
    assert correlate.summary_line(every).where("summary like '[CRITICAL] RECON%'").count() == 1


def test_a_busy_address_costs_no_more_than_its_rows(spark):
    """200,000 events of one address and user within one window: neither frames nor pairs may grow with their square."""
    kinds = F.array(*map(F.lit, ("auth_fail", "auth_success", "sudo", "user_add", "net_scan", "exploit")))
    rows = spark.range(200_000).select(F.col("id").alias("seq"), F.timestamp_micros(F.lit(1_775_037_600_000_000) + F.col("id") * 1000).alias("ts"), F.lit("x").alias("source"), F.element_at(kinds, (F.col("id") % 6 + 1).cast("int")).alias("event_type"), F.lit("9.9.9.9").alias("source_ip"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("username"), F.lit("h").alias("hostname"))
    began = time.time()
    found = {r.pattern: r.n for r in correlate.correlate(rows).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    assert time.time() - began < 90
    assert found["BRUTE_THEN_SUCCESS"] == found["SPRAY_THEN_PIVOT"] == found["RECON_THEN_EXPLOIT"] == 1
    assert found["PRIVILEGE_ESCALATION"] == 7 and found["PERSISTENCE"] == 33_333
    brute = correlate.brute_then_success(rows).collect()[0]
    assert (brute.seq, brute.event_count, brute.start_us, brute.sources) == (25, 6, 1_775_037_600_000_000, ["x"])


@pytest.mark.parametrize("seed", range(3))
def test_followers_of_each_head_are_the_first_three(spark, seed):
    rng, w = random.Random(seed), 30
    order = list(range(160))
    rng.shuffle(order)
    rows = [(s, rng.choice(["auth_success", "user_add"]), rng.choice(["a", "b", ""]), rng.choice(["u", "v", ""])) for s in (rng.randrange(300) for _ in order)]
    frame = corr(spark, rows)
    got = {r.seq: (r.event_count, r.end_us) for r in correlate.persistence(frame, window_s=w).collect()}
    want = {}
    for i, (s, t, ip, u) in enumerate(rows):
        near = [x for j, (x, k, jp, ju) in enumerate(rows) if k == "user_add" and 0 <= x - s <= w and (ip and ip == jp or u and u == ju)][:3]
        if t == "auth_success" and near:
            want[i] = (len(near) + 1, int((BASE + timedelta(seconds=max(near))).replace(tzinfo=UTC).timestamp()) * 1_000_000)
    assert got == want


def test_bounds_are_times(spark):
    rows = events(spark, [{"ts": at(24)}, {"ts": at(36)}, {"ts": None}])
    assert timeline.between(rows, "2026-04-02", "2026-04-02T12:00:00+00:00").count() == 3
    assert timeline.between(rows, "2026-04-02T01:00:00+01:00", "2026-04-02T11:59:59Z").count() == 2
    for bad in (("2024-1-9", None), ("yesterday", None), ("2024-01-10", "2024-01-09")):
        with pytest.raises(ValueError, match="ISO|after"):
            timeline.between(rows, *bad)


def test_types_are_inferred_in_order(spark):
    rows = [(1, "4624", "x"), (2, None, "Failed password for root"), (3, None, "New session opened"), (4, None, "cron job"), (5, None, "nothing"), (6, "odd", "windows_logon_failure")]
    got = spark.createDataFrame(rows, "i int, t string, m string").select("i", correlate.event_type(F.col("t"), F.col("m")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {1: "auth_success", 2: "auth_fail", 3: "auth_success", 4: "persistence", 5: "unknown", 6: "auth_success"}


def test_normalized_fields_and_times(spark):
    raw = spark.createDataFrame([(1, "1700000000", " 1.2.3.4 ", "", "bob"), (2, "2026-04-01T10:00:00Z", "", "5.6.7.8", None), (3, "bad", None, None, None)], "seq long, timestamp string, source_ip string, ip string, user string")
    got = {r.seq: (r.ts, r.source_ip, r.username) for r in correlate.normalized(raw, "s").collect()}
    assert got == {1: (datetime(2023, 11, 14, 22, 13, 20), "1.2.3.4", "bob"), 2: (BASE, "5.6.7.8", None), 3: (None, None, None)}


def hops(spark, rows):
    return spark.createDataFrame([(i, None if s is None else BASE + timedelta(seconds=s), ip, h, u) for i, (s, ip, h, u) in enumerate(rows)], "seq long, ts timestamp, source_ip string, target_host string, username string")


def test_sequential_chains(spark):
    chain = lambda rows, w=3600: [(r.pattern, r.target_hosts, r.confidence) for r in movement.sequential(hops(spark, rows), window_s=w).collect()]
    assert chain([(0, "i", "web01", "u"), (60, "i", "db01", "u")]) == [("SEQUENTIAL_HOP", ["web01", "db01"], 0.6)]
    assert chain([(0, "i", "web01", "u"), (60, "i", "web01", "u")]) == []
    assert chain([(0, "i", "host1", "u"), (200, "i", "host2", "u"), (250, "i", "host3", "u")], 60) == [("SEQUENTIAL_HOP", ["host2", "host3"], 0.6)]
    assert chain([(0, "i", "h1", "u"), (1, "i", "h2", "u"), (None, "i", "h3", "u")]) == [("MULTI_HOP_CHAIN", ["h1", "h2", "h3"], 0.8)]


def test_fan_out_and_reuse(spark):
    rows = [(0, "i", "h1", "admin"), (10, "i", "h2", "admin"), (20, "j", "h3", "admin"), (None, "i", "h3", "b"), (5000, "i", "h4", "b")]
    assert [(r.source_ip, r.target_hosts) for r in movement.fan_out(hops(spark, rows)).collect()] == [("i", ["h1", "h2", "h3"])]
    assert {r.usernames[0]: (r.source_ip, len(r.target_hosts)) for r in movement.credential_reuse(hops(spark, rows)).collect()} == {"admin": ("i", 3), "b": ("i", 2)}
    every = movement.chains(hops(spark, rows))
    assert movement.through_host(every, "H3").count() >= 2 and movement.report(every).collect()[0].unique_hosts == 4


def test_hops_are_logins_with_a_place(spark):
    rows = corr(spark, [(0, "auth_success", "", "u"), (0, "auth_fail", "i", "u"), (0, "x", "i", "session opened")]).withColumn("hostname", F.lit(" /Web01 "))
    assert [(r.source_ip, r.target_host) for r in movement.hops(rows).orderBy("seq").collect()] == [("unknown", "web01"), ("i", "web01")]


def test_gaps_at_the_threshold(spark):
    two = lambda minutes: events(spark, [{"ts": at(0)}, {"ts": at(0) + timedelta(minutes=minutes)}])
    assert [r.duration_s for r in timeline.gaps(two(180), threshold_s=3600).collect()] == [10800]
    assert timeline.gaps(two(60), threshold_s=3600).count() == 0
    rows = timeline.interleaved(events(spark, [{"ts": at(4)}, {"ts": at(1)}]), threshold_min=60).orderBy("pos").collect()
    assert [(r.entry_type, r.duration_min) for r in rows] == [("event", None), ("gap", 180.0), ("event", None)]
    days = events(spark, [{"ts": at(h)} for h in (1, 30, 31, 80)])
    assert sorted(r.duration_s / 3600 for r in timeline.global_gaps(days, threshold_s=3600).collect()) == [29, 49]


def test_filters(spark):
    rows = events(spark, [{"severity": s, "host": h, "ts": t} for s, h, t in (("low", "A", at(8)), ("medium", "b", at(10)), ("HIGH", None, at(12)), ("critical", "a", None), ("odd", "a", at(14)))])
    assert timeline.at_least(rows, "high").count() == 2 and timeline.at_least(rows, "info", drop_unknown=True).count() == 4 and timeline.at_least(rows, "nonsense").count() == 5
    assert timeline.between(rows, at(9), at(13)).count() == 3 and timeline.of_host(rows, "a").count() == 3
    with pytest.raises(ValueError, match="since"):
        timeline.between(rows, at(3), at(1))
    mixed = timeline.interleaved(rows, threshold_min=60)
    assert timeline.at_least(mixed, "critical").where("entry_type = 'gap'").count() == 3 and timeline.without_gaps(mixed).count() == 4
    assert [r.severity for r in timeline.ordered(rows.where("ts is not null"), descending=True).limit(1).collect()] == ["odd"]


def test_diff(spark):
    a = events(spark, [{"ts": BASE, "action": "X "}, {"action": "same"}, {"action": "gone"}])
    b = events(spark, [{"ts": BASE + timedelta(milliseconds=300), "action": "x"}, {"action": "same"}, {"action": "new", "severity": "high", "actor": None}])
    assert sorted((r.change, r.action) for r in diff.changes(a, b).collect()) == [("added", "new"), ("removed", "gone")]
    assert diff.unchanged(a, b).collect()[0].unchanged == 2 and diff.totals(diff.changes(a, b)).collect()[0].has_new_high_severity
    assert diff.changes(a, a).count() == 0


def test_attack_mapping(spark):
    got = attack.mapped(events(spark, [{"action": a} for a in (" SSH_Login ", "ran brute dump", "opened", None)])).collect()
    assert {r.action: (r.technique_id, r.confidence) for r in got} == {" SSH_Login ": ("T1021.004", "medium"), "ran brute dump": ("T1110", "medium"), "opened": (None, None), None: (None, None)}


def test_rules(spark):
    frame = spark.createDataFrame([("4104", "powershell.exe"), ("1", None)], "event_id string, process_name string")
    rule = {"title": "t", "detection": {"sel1": {"event_id": "4104", "process_name": "powershell.exe"}, "condition": "sel1"}}
    assert [r.flagged for r in rules.evaluate(frame, [rule, {"title": ""}]).collect()] == [True, False]
    assert [r.flagged for r in rules.evaluate(frame, []).collect()] == [False, False]
    nothing = {"title": "n", "detection": {"sel": {"absent": "None"}, "condition": "all of se*"}}
    assert all(r.flagged for r in rules.evaluate(frame, [nothing]).collect())


def found(df):
    return sorted({(r.check_id, r.severity) for r in df.collect()})


def test_process_checks(spark):
    row = lambda name, parent="", line="x", path="", n=0: ("h", 1, 0, name, line, parent, path, n)
    table = lambda *r: spark.createDataFrame(list(r), "subject string, pid long, ppid long, name string, cmdline string, parent_name string, path string, child_count int")
    ids = lambda *r: [c for c, _ in found(checks.process_findings(table(*r)))]
    assert ids(row("CMD.exe", "WinWord.exe")) == ["PT-001"] and ids(row("lsass.exe", path="C:\\x")) == ["PT-002"] and ids(row("lsass.exe", path="")) == []
    assert ids(row("certutil.exe")) == ["PT-003"] and ids(row("cmd.exe", "svchost.exe")) == ["PT-004"] and ids(row("cmd.exe", line=" CMD.EXE ")) == ["PT-005"]
    assert ids(row("a", n=20)) == [] and ids(row("a", n=21)) == ["PT-006"] and ids(row("a", line="run MimiKatz")) == ["PT-007"]
    assert ids(("h", None, None, None, None, None, None, None)) == []
    score = checks.scores(checks.process_findings(table(row("mimikatz"), row("cmd.exe", "winword.exe"), row("lsass.exe", path="C:\\t"), row("mimikatz"))))
    assert [(r.risk_score, r.findings, r.checks) for r in score.collect()] == [(100, 4, 3)]


def test_only_registry_evidence_is_cut(spark):
    line = "powershell -enc " + "QUJD" * 300 + " mimikatz"
    frame = spark.createDataFrame([("h", 1, 0, "certutil.exe", line, "", "", 0)], "subject string, pid long, ppid long, name string, cmdline string, parent_name string, path string, child_count int")
    assert {r.check_id: r.evidence for r in checks.process_findings(frame).collect()} == {"PT-003": line, "PT-007": "mimikatz"}
    path = "/tmp/" + "a/" * 400 + "x"
    memory = spark.createDataFrame([("h", 1, "x", "/x", "", 0, "", [f"7f-80 r-xp 0 fd:01 1 {path}"], True)], "subject string, pid long, comm string, exe string, cmdline string, ppid long, parent_comm string, maps array<string>, accessible boolean")
    assert [(r.check_id, r.evidence) for r in checks.memory_findings(memory).collect()] == [("MA-003", path)]
    host = "".join("abcdefghijklmnopqrstuvwxyz0123456789"[i % 36] for i in range(700))
    connection = spark.createDataFrame([("h", 1, "p", "l", 1, "8.8.8.8", 443, "", "tcp", host)], "subject string, pid long, process_name string, local_addr string, local_port int, remote_addr string, remote_port int, state string, protocol string, hostname string")
    assert [(r.check_id, r.evidence) for r in checks.connection_findings(connection).collect()] == [("NC-003", host)]
    entry = spark.createDataFrame([("h", "appinit_dlls", None, None, "v" * 600, None, None, None, None, "k")], "subject string, kind string, hive string, name string, value string, path string, image_path string, image string, debugger string, key string")
    assert [r.evidence for r in checks.registry_findings(entry).collect()] == ["v" * 512]


def test_connection_checks(spark):
    def ids(*rows):
        return [c for c, _ in found(checks.connection_findings(spark.createDataFrame([("h", 1, "p", "l", lp, a, rp, s, "tcp", n) for lp, a, rp, s, n in rows], "subject string, pid long, process_name string, local_addr string, local_port int, remote_addr string, remote_port int, state string, protocol string, hostname string")))]

    out = (1, "8.8.8.8", 443, "ESTABLISHED", None)
    assert ids(*[out] * 20) == [] and ids(*[out] * 21) == ["NC-002"]
    assert ids(*[(i, "", 0, "LISTEN", None) for i in range(5)]) == [] and ids(*[(i, "", 0, "LISTEN", None) for i in range(6)]) == ["NC-006"]
    assert ids((1, "8.8.8.8", 9001, "", None)) == ["NC-001", "NC-005"] and ids((1, "8.8.8.8", 14433, "", None)) == ["NC-004"]
    assert ids((1, "10.1.1.1", 445, "ESTABLISHED", None)) == ["NC-007"] and ids((1, "11.1.1.1", 445, "ESTABLISHED", None)) == []
    assert ids((1, "8.8.8.8", 443, "", "q7x9kfj2m4n8b1v5c3z6.example")) == ["NC-003"] and ids((1, "8.8.8.8", 443, "", "a" * 40)) == []


def test_script_checks(spark):
    def risk(text):
        r = checks.script_risk(checks.script_checks(spark.createDataFrame([(text,)], "command_text string"))).collect()[0]
        return [c.check_id for c in r.checks], r.risk_score, r.threat_level

    assert risk("i`e`x") == (["PSA-006"], 20, "MEDIUM") and risk("certutil x") == (["PSA-005"], 25, "MEDIUM") and risk("p -enc x") == (["PSA-001"], 45, "HIGH")
    assert risk("p -enc x; Invoke-Mimikatz") == (["PSA-001", "PSA-007"], 90, "CRITICAL") and risk(None) == ([], 0, "LOW") and risk("IEX (curl x)")[0] == ["PSA-003"]
    assert risk('"a"+"b"+"c"')[0] == [] and risk('"a"+"b"+"c"+"d"')[0] == ["PSA-006"]


def test_registry_checks(spark):
    def ids(kind, all_=False, **fields):
        names = ["hive", "name", "value", "path", "image_path", "image", "debugger", "key"]
        frame = spark.createDataFrame([("h", kind, *(fields.get(n) for n in names))], "subject string, kind string, " + ", ".join(f"{n} string" for n in names))
        return found(checks.registry_findings(frame, all_run=all_, all_services=all_))

    assert ids("run_keys", value="C:\\Users\\x.exe") == [("REG-P-001", "HIGH")] and ids("run_keys", value="C:\\ok.exe") == [] and ids("run_keys", True, value="C:\\ok.exe") == [("REG-P-001", "MEDIUM")]
    assert ids("services", image_path="%TEMP%\\s") == [("REG-P-004", "CRITICAL")] and ids("services", True, image_path="x") == [("REG-P-004", "LOW")]
    assert ids("winlogon_entries", key="Shell", value=" Explorer.exe ") == [] and ids("winlogon_entries", key="shell", value="x") == [("REG-P-007", "CRITICAL")] and ids("winlogon_entries", key="taskman", value="") == [("REG-P-007", "CRITICAL")]
    assert ids("appinit_dlls", value="") == [] and ids("startup_files", path="a.lnk") == [("REG-P-003", "MEDIUM")]


def test_memory_checks(spark):
    def ids(comm="sshd", exe="/usr/bin/sshd", parent="systemd", maps=(), ok=True):
        frame = spark.createDataFrame([("h", 1, comm, exe, "", 0, parent, list(maps), ok)], "subject string, pid long, comm string, exe string, cmdline string, ppid long, parent_comm string, maps array<string>, accessible boolean")
        return [c for c, _ in found(checks.memory_findings(frame))]

    assert ids(maps=["7f-80 r-xp 0 fd:01 1    /usr/lib/libc.so.6"]) == [] and ids(maps=["7f-80 rwxp 0 0:0 0"]) == ["MA-001"] and ids(maps=["7f-80 rw-p 0 0:0 0"]) == []
    assert ids(maps=["7f-80 r-xp 0 fd:01 1 /tmp/a (deleted)"]) == ["MA-002", "MA-003"] and ids(exe="/x/evil") == ["MA-004"] and ids("bash", "/bin/bash", "Nginx") == ["MA-005"]
    assert ids(exe="/usr/bin/sshd (deleted)") == ["MA-006"] and ids(maps=["7f-80 rwxp 0 0:0 0"], ok=False) == [] and ids(maps=["7f-80 r-xp 0 f 1 /opt/aB3dE6gH9jK2mN5pQ8"]) == ["MA-007"]


@pytest.mark.parametrize(("address", "inside"), [("10.0.0.1", True), ("172.32.0.1", False), ("[fd00::1]", True), ("fe80::1%en0", True), ("::ffff:192.168.1.25", True), ("0:0:0:0:0:ffff:10.0.0.1", True), ("2001:db8::1", False), ("", False), (None, False)])
def test_internal_addresses(spark, address, inside):
    assert spark.createDataFrame([(address,)], "a string").select(scalar.internal(F.col("a"))).collect()[0][0] is inside


def test_scalars(spark):
    row = spark.range(1).select(scalar.entropy(F.lit("abcdabcdxyz")), scalar.entropy(F.lit("")), scalar.without_deleted(F.lit("/tmp/model (deleted)")), scalar.without_deleted(F.lit("/tmp/model (deleted)"), exact=True), scalar.masked(F.lit("API_KEY=s")), scalar.masked(F.lit("NO_EQUALS")), scalar.formula_safe(F.lit(" =1")), scalar.is_ip(F.lit("1.2.3.999")), scalar.is_ip(F.lit("::1")), scalar.is_ip(F.lit("user"))).collect()[0]
    assert round(row[0], 3) == 2.732 and row[1] == 0 and tuple(row)[2:] == ("/tmp/mo", "/tmp/model", "API_KEY=****[MASKED]", "NO_EQUALS", "' =1", False, True, False)


def test_auth_log(spark):
    lines = ["Jan 12 10:22:01 labhost sshd[1234]: Failed password for invalid user admin from 10.0.0.5 port 54422 ssh2", "Jan  2 10:22:10 labhost sshd[1]: Accepted password for analyst from 10.0.0.8 port 60211 ssh2", "Jan 12 10:23:00 labhost sudo: analyst : TTY=pts/0 ; PWD=/home/analyst ; USER=root ; COMMAND=/usr/bin/id", "other", ""]
    got = logs.auth_events(spark.createDataFrame([(x, "f") for x in lines], "line string, source string"), year=2026).orderBy("raw").collect()
    assert [(r.action, r.actor, r.target, r.ts) for r in got] == [("ssh_login_success", "10.0.0.8", "analyst", datetime(2026, 1, 2, 10, 22, 10)), ("ssh_login_failed", "10.0.0.5", "admin", datetime(2026, 1, 12, 10, 22, 1)), ("sudo_command", "analyst", "root", datetime(2026, 1, 12, 10, 23))]
    assert got[1].metadata == {"src_ip": "10.0.0.5", "src_port": "54422"} and got[2].metadata == {"command": "/usr/bin/id"}


def test_mac_log(spark):
    lines = ["2026-04-09 10:12:00.100000-0300 0x1 authd: Authentication failed for user analyst from 10.0.0.8", "2026-04-09 10:12:00Z authd: Authenticated user bob", "2026-04-09 10:13:00Z sudo[1]:  bob : TTY=x ; USER=root ; COMMAND=/bin/ls ", "2026-04-09 10:14:00Z launchd: service loaded: /Library/LaunchAgents/a.plist", "2026-99-09 10:14:00Z Authenticated user x", "junk"]
    got = logs.mac_events(spark.createDataFrame([(x, "f") for x in lines], "line string, source string")).orderBy("ts").collect()
    assert [(r.action, r.actor, r.target) for r in got] == [("macos_authentication_success", None, "bob"), ("macos_sudo_execution", "bob", "root"), ("macos_launchd_persistence_loaded", None, "/Library/LaunchAgents/a.plist"), ("macos_authentication_failure", "10.0.0.8", "analyst")]
    assert got[3].ts == datetime(2026, 4, 9, 13, 12, 0, 100000)


def test_windows_xml(spark, tmp_path):
    event = lambda i, t, d: f"<Event><System><EventID>{i}</EventID><TimeCreated SystemTime='{t}'/></System><EventData>{d}</EventData></Event>"
    data = "".join(f"<Data Name='{n}'>{v}</Data>" for n, v in (("IpAddress", ""), ("IpAddress", "9"), ("WorkstationName", "WS"), ("TargetUserName", "Administrator"), ("LogonType", "3")))
    (tmp_path / "a.xml").write_text("<Events xmlns='http://schemas.microsoft.com/win/2004/08/events/event'>" + event(4625, "2026-04-01T10:00:00Z", data) + event(7045, "2026-04-01T10:01:00Z", "<Data Name='ServiceName'>svc</Data>") + event(4625, "never", "") + event("x", "2026-04-01T10:01:00Z", "") + event(1, "2026-04-01T10:02:00Z", "") + "</Events>")
    (tmp_path / "b.xml").write_text("<Events><Event><System>")
    got = windows.windows_events(windows.read_windows_xml(spark, str(tmp_path))).orderBy("ts").collect()
    assert [(r.action, r.severity, r.actor, r.target) for r in got] == [("windows_logon_failure", "medium", "WS", "Administrator"), ("windows_service_installed", "high", None, "svc"), ("windows_event_1", "info", None, None)]
    assert got[0].metadata["logon_type"] == "3"


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"host": "a", "severity": "high"}\n{"host": "b"}\n')
    (tmp_path / "o.json").write_text('{"timeline": [{"host": "c"}, {"host": "d"}]}')
    assert readers.read_events(spark, f"{tmp_path}/l.jsonl").count() == 2
    assert sorted(r.host for r in readers.read_events(spark, f"{tmp_path}/o.json", lines=False).collect()) == ["c", "d"]
    (tmp_path / "h.json").write_text('{"case_id": "c", "platform": "macos", "observations": {"a": "1", "b": null}}\n')
    assert [(r.key, r.value) for r in readers.observations(spark, f"{tmp_path}/h.json").collect()] == [("a", "1")]
    case = tmp_path / "case"
    case.mkdir()
    (case / "x.log").write_text("one")
    (case / "integrity_manifest.json").write_text("{}")
    manifest = readers.evidence(spark, str(case))
    assert [r.path for r in manifest.collect()] == ["x.log"]
    kept = spark.createDataFrame(manifest.collect())
    (case / "x.log").write_text("two")
    assert records.verified(kept, readers.evidence(spark, str(case))).collect()[0].ok is False


def test_records(spark):
    frame = spark.createDataFrame([("t", None), (None, "h")], "timestamp string, host string")
    assert records.valid(frame, ("timestamp",)).count() == 1 and records.rejects(frame, ("timestamp", "source")).count() == 2
    with pytest.raises(Exception, match="missing fields: source"):
        records.valid(frame, ("source",), strict=True).collect()
    assert [r[0] for r in spark.createDataFrame([("a",), (" ",), ("..",), ("a/b",), (None,)], "c string").select(records.valid_case_id(F.col("c"))).collect()] == [True, False, False, False, False]
    tags = spark.createDataFrame([(["T1", " T2", None], "T2, T3,")], "attack_tags array<string>, tags string")
    assert tags.select(records.attack_tags(tags)).collect()[0][0] == ["T1", "T2", "T3"]


def test_exports(spark):
    rows = events(spark, [{"actor": "1.2.3.4", "target": "root", "severity": "high", "raw": "a=b|c\nd", "category": "authentication"}, {"ts": BASE + timedelta(hours=3), "actor": "bob", "raw": " =SUM(1,1)"}])
    mixed = timeline.interleaved(rows, threshold_min=60)
    cef = [r.value for r in export.cef_lines(mixed, case_id="c", vendor="v", product="p", version="1").collect()]
    assert sum("Timeline Gap|3|" in x for x in cef) == 1 and any("|8|" in x and "src=1.2.3.4" in x and "msg=a\\=b|c\\nd" in x for x in cef) and any("suser=bob" in x for x in cef)
    ecs = [r.value for r in export.ecs_lines(mixed, case_id="c", product="p").collect()]
    assert any('"severity":73' in x and '"ip":"1.2.3.4"' in x for x in ecs) and any('"duration":10800000000000' in x for x in ecs)
    assert {r.raw for r in export.csv_rows(mixed).collect()} == {"a=b|c\nd", "' =SUM(1,1)", None}
    with pytest.raises(ValueError, match="form"):
        export.run(rows, "/nowhere", "xls")
    assert export.all_columns_csv(rows).columns == sorted(rows.columns) and export.timesketch(rows, parser="p").columns[:3] == ["datetime", "timestamp_desc", "message"]


def test_export_run_filters_and_writes(spark, tmp_path):
    rows = events(spark, [{"severity": "high"}, {"severity": "low"}]).withColumn("tags", F.when(F.col("seq") == 0, "T1"))
    export.run(rows, f"{tmp_path}/a", "jsonl", severity="HIGH")
    export.run(rows, f"{tmp_path}/b", "csv", attack_only=True)
    export.run(rows, f"{tmp_path}/c", "timesketch", category="system")
    assert spark.read.json(f"{tmp_path}/a").count() == 1 and spark.read.option("header", True).csv(f"{tmp_path}/b").count() == 1
    assert spark.read.json(f"{tmp_path}/c").count() == 2


def test_lines_and_zones(spark):
    row = spark.range(1).select(scalar.in_zone(F.lit(BASE), "America/Sao_Paulo", F.lit("x")), scalar.in_zone(F.lit(None).cast("timestamp"), "UTC", F.lit("raw"))).collect()[0]
    assert tuple(row) == ("2026-04-01T07:00:00-03:00", "raw")
    a, b = events(spark, [{"action": "x"}]), events(spark, [{"action": "y", "severity": "high"}])
    changed = diff.changes(a, b)
    assert [tuple(r) for r in diff.added_by_category(changed).collect()] == [("system", 1)]
    assert diff.summary_line(diff.totals(changed)).collect()[0].summary == "2 changes: 1 added, 1 removed, new high severity"
    line = movement.summary_line(movement.sequential(hops(spark, [(0, "i", "a", "u"), (1, "i", "b", "u")]))).collect()[0].summary
    assert line == "[HIGH] SEQUENTIAL_HOP by i: a > b"
