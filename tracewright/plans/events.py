"""Queries over events: correlation, movement, timelines, differences, techniques, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import tables as T
from tracewright.functions.scalar import in_zone, iso
from tracewright.operators import attack, correlate, diff, movement, rule_index, rules, timeline
from tracewright.plans.derived import duck, view

WEEK, DAY = 604_800, 86_400
E = f"WITH e AS ({duck('corr_events')}), u AS (SELECT *, epoch_us(ts) us FROM e)"
TL = f"WITH t AS ({duck('timeline')}), z AS (SELECT *, epoch_us(ts) us FROM t)"
RULES = [
    {"title": "High failures", "level": "high", "detection": {"sel": {"category": "authentication", "severity": ["high", "critical"]}, "condition": "sel"}},
    {"title": "Either", "level": "low", "detection": {"one": [{"action": "log_clear"}, {"action": "cron_add"}], "two": {"host": "host3"}, "condition": "one and two"}},
    {"title": "Any of", "detection": {"sel_a": {"target": "target1"}, "sel_b": {"target": "target2"}, "other": {"host": "host1"}, "condition": "1 of sel*"}},
    {"title": "All of", "detection": {"sel_a": {"target": "target3"}, "sel_b": {"host": "host5"}, "condition": "all of sel*"}},
    {"level": "high", "detection": {"sel": {"host": "host1"}, "condition": "sel"}},
]
#: As many rules as a large rule set has, each of its own host, target and actors.
MANY_RULES = [{"title": f"R{i}", "level": ["low", "high"][i % 2], "detection": {"sel": {"host": f"host{i % 12}", "target": f"target{i % 7}", "actor": [f"user{i % 20}", f"10.0.0.{i % 200}"]}, "late": {"severity": "critical", "category": "system"}, "condition": "sel and late" if i % 3 else "sel"}} for i in range(3000)]


def ev(spark, d):
    return view(spark, d, "corr_events")


def tl(spark, d):
    return view(spark, d, "timeline")


def hops(spark, d):
    return movement.hops(ev(spark, d), blob=F.lit(""))


def _related(rows: str, pattern: str, severity: str, confidence: float) -> str:
    """Heads h (seq, us, source_ip, username) with pairs p (seq, rseq, rus): the first three related."""
    return f"""{rows}, k AS (SELECT seq, count(*) related, max(rus) last FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rseq) r FROM p) WHERE r <= 3 GROUP BY seq)
SELECT '{pattern}' pattern, '{severity}' severity, CAST({confidence} AS DOUBLE) confidence, h.seq, h.source_ip, h.username, related + 1 event_count, h.us start_us, greatest(h.us, last) end_us FROM h JOIN k USING (seq)"""


BRUTE = f"""{E}, w AS (SELECT *, count(*) FILTER (event_type = 'auth_fail') OVER v n, min(us) FILTER (event_type = 'auth_fail') OVER v start_us FROM u WHERE event_type IN ('auth_fail', 'auth_success') WINDOW v AS (PARTITION BY source_ip ORDER BY us RANGE BETWEEN {WEEK}000000 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq) r FROM w WHERE event_type = 'auth_success' AND n >= 5)"""
PRIV = f"""{E}, s AS (SELECT a.*, row_number() OVER (PARTITION BY a.username ORDER BY a.seq) r FROM u a WHERE a.event_type = 'auth_success' AND EXISTS (SELECT 1 FROM u b WHERE b.event_type = 'sudo' AND b.username = a.username AND b.us - a.us BETWEEN 0 AND {DAY}000000)),
h AS (SELECT * FROM s WHERE r = 1), p AS (SELECT h.seq, b.seq rseq, b.us rus FROM h JOIN u b ON b.event_type = 'sudo' AND b.username = h.username AND b.us - h.us BETWEEN 0 AND {DAY}000000)"""
PERSIST = f"""{E}, h AS (SELECT * FROM u WHERE event_type = 'auth_success'), p AS (SELECT DISTINCT h.seq, b.seq rseq, b.us rus FROM h JOIN u b ON b.event_type IN ('user_add', 'persistence') AND (b.username = h.username OR b.source_ip = h.source_ip) AND b.us - h.us BETWEEN 0 AND {DAY}000000)"""
RECON = f"""{E}, h AS (SELECT source_ip, max(seq) seq, arg_max(us, seq) us, arg_max(username, seq) username FROM u WHERE event_type = 'net_scan' GROUP BY 1), p AS (SELECT h.seq, b.seq rseq, b.us rus FROM h JOIN u b ON b.event_type = 'exploit' AND b.source_ip = h.source_ip AND b.us - h.us BETWEEN 0 AND {WEEK}000000)"""
HOPS = f"{E}, hop AS (SELECT seq, us, source_ip, lower(hostname) target_host, username FROM u WHERE event_type = 'auth_success')"
SEQ = f"""{HOPS}, a AS (SELECT *, lag(target_host) OVER (PARTITION BY source_ip ORDER BY us, seq) before FROM hop), b AS (SELECT *, us - lag(us) OVER (PARTITION BY source_ip ORDER BY us, seq) gap FROM a WHERE before IS NULL OR before <> target_host),
c AS (SELECT *, sum(CASE WHEN gap > {WEEK}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY us, seq ROWS UNBOUNDED PRECEDING) chain FROM b),
g AS (SELECT source_ip, chain, count(*) n, count(DISTINCT target_host) hosts, array_to_string(list_sort(list(DISTINCT username)), ',') usernames, min(us) start_us, max(us) end_us, arg_min(target_host, (us, seq)) first_host FROM c GROUP BY 1, 2 HAVING count(*) >= 2)"""
KW = " ".join(f"WHEN contains(a, '{k}') THEN '{i}|{t}'" for k, i, _, t, _ in T.TECHNIQUE_KEYWORDS)
EXACT = " ".join(f"WHEN '{k}' THEN '{i}|{t}'" for k, i, _, t, _ in T.TECHNIQUES)
MAPPED = f"{TL}, m AS (SELECT *, coalesce(CASE a {EXACT} END, CASE {KW} END) mt FROM (SELECT *, lower(trim(action)) a FROM z)), q AS (SELECT *, split_part(mt, '|', 1) technique_id, split_part(mt, '|', 2) tactic FROM m)"
WORDS = " ".join("WHEN " + " OR ".join(f"contains(b, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in T.KEYWORD_TYPES)
KEYED = "SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts), source, lower(trim(action)), actor, target ORDER BY seq DESC) r FROM t WHERE"
DIFF = f"""WITH t AS ({duck('timeline')}), b AS (SELECT * FROM ({KEYED} seq % 10 <> 0) WHERE r = 1), a AS (SELECT * FROM ({KEYED} seq % 10 <> 1) WHERE r = 1)"""
SAME = "date_trunc('second', a.ts) = date_trunc('second', b.ts) AND a.source = b.source AND lower(trim(a.action)) = lower(trim(b.action)) AND a.actor = b.actor AND a.target = b.target"
RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
GAP = f"{TL}, l AS (SELECT *, lag(us) OVER (PARTITION BY case_id ORDER BY us, source, action) p, row_number() OVER (PARTITION BY case_id ORDER BY us, source, action) rn FROM z)"


def raw_rows(spark, d):
    """Events as a foreign log would have them: epoch seconds, a message, a user."""
    word = F.when(F.col("event_id") % 3 == 0, "password for ").when(F.col("event_id") % 3 == 1, "nmap run of ").otherwise("")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat(F.lit("Failed "), word, "event_type").alias("message"), F.col("user_id").alias("user"))


def halves(spark, d):
    rows = tl(spark, d)
    return rows.where("seq % 10 <> 0"), rows.where("seq % 10 <> 1")


def us(*columns):
    return [F.unix_micros(c).alias(f"{c}_us") for c in columns]


def longs(df):
    return df.select(*((F.col(c).cast("long") if k == "int" else F.col(c)).alias(c) for c, k in df.dtypes))


QUERIES = {
    "brute_then_success": (lambda s, d: correlate.brute_then_success(ev(s, d), window_s=WEEK).drop("sources"), f"{BRUTE} SELECT 'BRUTE_THEN_SUCCESS' pattern, 'CRITICAL' severity, round(least(0.95, 0.6 + 0.01 * n), 6) confidence, seq, source_ip, username, n + 1 event_count, start_us, us end_us FROM f WHERE r = 1"),
    "brute_evidence": (lambda s, d: correlate.brute_evidence(e := ev(s, d), correlate.brute_then_success(e, window_s=WEEK), window_s=WEEK), f"{BRUTE} SELECT f.seq incident_seq, u.seq FROM f JOIN u ON u.source_ip = f.source_ip AND u.event_type = 'auth_fail' AND u.us BETWEEN f.us - {WEEK}000000 AND f.us WHERE r = 1"),
    "spray_then_pivot": (lambda s, d: correlate.spray_then_pivot(ev(s, d), window_s=WEEK).drop("start_us", "sources"), f"""{E}, n AS (SELECT a.seq, a.us, a.source_ip, a.username, count(DISTINCT b.username) n FROM u a JOIN u b ON b.source_ip = a.source_ip AND b.event_type = 'auth_fail' AND b.us BETWEEN a.us - {WEEK}000000 AND a.us WHERE a.event_type = 'auth_success' GROUP BY ALL HAVING count(DISTINCT b.username) >= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq) r FROM n) SELECT 'SPRAY_THEN_PIVOT' pattern, 'CRITICAL' severity, round(least(0.9, 0.5 + 0.02 * n), 6) confidence, seq, source_ip, username, n + 1 event_count, us end_us FROM f WHERE r = 1"""),
    "privilege_escalation": (lambda s, d: correlate.privilege_escalation(ev(s, d), window_s=DAY).drop("sources"), _related(PRIV, "PRIVILEGE_ESCALATION", "HIGH", 0.8)),
    "persistence": (lambda s, d: correlate.persistence(ev(s, d), window_s=DAY).drop("sources"), _related(PERSIST, "PERSISTENCE", "HIGH", 0.75)),
    "recon_then_exploit": (lambda s, d: correlate.recon_then_exploit(ev(s, d), window_s=WEEK).drop("sources"), _related(RECON, "RECON_THEN_EXPLOIT", "CRITICAL", 0.85)),
    "anomalous_time": (lambda s, d: correlate.anomalous_time(ev(s, d)).drop("sources"), f"{E} SELECT 'ANOMALOUS_TIME' pattern, 'MEDIUM' severity, CAST(0.6 AS DOUBLE) confidence, seq, source_ip, username, CAST(1 AS BIGINT) event_count, us start_us, us end_us FROM u WHERE event_type = 'auth_success' AND hour(ts) NOT BETWEEN 7 AND 18"),
    "incident_report": (lambda s, d: correlate.report(correlate.anomalous_time(e := ev(s, d)).unionByName(correlate.persistence(e, window_s=DAY))), f"""WITH i AS (SELECT * FROM ({_related(PERSIST, "PERSISTENCE", "HIGH", 0.75)}) UNION ALL SELECT 'ANOMALOUS_TIME', 'MEDIUM', 0.6, seq, source_ip, username, 1, epoch_us(ts), epoch_us(ts) FROM ({duck('corr_events')}) WHERE event_type = 'auth_success' AND hour(ts) NOT BETWEEN 7 AND 18)
SELECT count(*) incidents, count(*) FILTER (severity = 'CRITICAL') critical, count(*) FILTER (severity = 'HIGH') high, CAST(sum(event_count) AS BIGINT) events, max(end_us - start_us) longest_us FROM i"""),
    "normalized_types": (lambda s, d: correlate.normalized(raw_rows(s, d), "events").groupBy("event_type", "username").agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last_us")), f"""
WITH r AS (SELECT event_id seq, epoch_us(ts) // 1000000 AS ts, concat('Failed ', CASE event_id % 3 WHEN 0 THEN 'password for ' WHEN 1 THEN 'nmap run of ' ELSE '' END, event_type) message, user_id FROM events),
b AS (SELECT *, lower(concat_ws(' ', CAST(seq AS VARCHAR), CAST(ts AS VARCHAR), message, CAST(user_id AS VARCHAR))) b FROM r)
SELECT CASE {WORDS} ELSE 'unknown' END event_type, CAST(user_id AS VARCHAR) username, count(*) n, max(ts) * 1000000 last_us FROM b GROUP BY 1, 2"""),
    "sequential_hops": (lambda s, d: movement.sequential(hops(s, d), window_s=WEEK).select("source_ip", "pattern", "severity", "confidence", "hop_count", F.size("target_hosts").cast("long").alias("hosts"), F.element_at("target_hosts", 1).alias("first_host"), F.array_join("usernames", ",").alias("usernames"), "start_us", "end_us"), f"""{SEQ} SELECT source_ip, CASE WHEN n >= 3 THEN 'MULTI_HOP_CHAIN' ELSE 'SEQUENTIAL_HOP' END pattern, CASE WHEN n >= 3 THEN 'CRITICAL' ELSE 'HIGH' END severity,
round(CASE WHEN n >= 3 THEN least(0.95, least(0.9, 0.4 + 0.1 * n) + 0.1) ELSE least(0.9, 0.4 + 0.1 * n) END, 6) confidence, n hop_count, hosts, first_host, usernames, start_us, end_us FROM g"""),
    "fan_out": (lambda s, d: movement.fan_out(hops(s, d), window_s=WEEK).select("source_ip", "pattern", "severity", "confidence", "hop_count", F.array_join("target_hosts", ",").alias("hosts"), "start_us", "end_us"), f"""{HOPS}, m AS (SELECT *, min(us) OVER (PARTITION BY source_ip) f FROM hop) SELECT source_ip, 'FAN_OUT' pattern, 'HIGH' severity, round(least(0.85, 0.4 + 0.05 * count(DISTINCT target_host)), 6) confidence, count(*) hop_count, array_to_string(list_sort(list(DISTINCT target_host)), ',') hosts, min(us) start_us, max(us) end_us FROM m WHERE us - f <= {WEEK}000000 GROUP BY source_ip HAVING count(DISTINCT target_host) >= 3"""),
    "credential_reuse": (lambda s, d: movement.credential_reuse(hops(s, d)).select("source_ip", "confidence", "hop_count", F.array_join("target_hosts", ",").alias("hosts"), F.element_at("usernames", 1).alias("username"), "start_us", "end_us"), f"{HOPS} SELECT arg_min(source_ip, (us, seq)) source_ip, round(least(0.8, 0.5 + 0.05 * count(DISTINCT target_host)), 6) confidence, count(*) hop_count, array_to_string(list_sort(list(DISTINCT target_host)), ',') hosts, username, min(us) start_us, max(us) end_us FROM hop GROUP BY username HAVING count(DISTINCT target_host) >= 2"),
    "movement_report": (lambda s, d: movement.report(movement.sequential(hops(s, d), window_s=WEEK)), f"{SEQ} SELECT count(*) chains, count(*) FILTER (n >= 3) critical, count(*) FILTER (n < 3) high, CAST(sum(n) AS BIGINT) hops, (SELECT count(DISTINCT target_host) FROM c JOIN g USING (source_ip, chain)) unique_hosts FROM g"),
    "gaps": (lambda s, d: timeline.gaps(tl(s, d), threshold_s=3600).select("case_id", *us("start", "end"), "duration_s"), f"{GAP} SELECT case_id, p start_us, us end_us, (us - p) / 1e6 duration_s FROM l WHERE us - p > 3600000000"),
    "global_gaps": (lambda s, d: timeline.global_gaps(tl(s, d), threshold_s=900).select(*us("start", "end"), "duration_s"), f"{TL}, l AS (SELECT lag(us) OVER (ORDER BY us) p, us FROM z) SELECT p start_us, us end_us, (us - p) / 1e6 duration_s FROM l WHERE us - p > 900000000"),
    "interleaved_timeline": (lambda s, d: timeline.interleaved(tl(s, d), threshold_min=60).select("case_id", "entry_type", F.col("pos").cast("long").alias("pos"), F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("duration_min", F.lit(0.0)).alias("duration_min")), f"{GAP} SELECT case_id, 'event' entry_type, 2 * rn pos, seq, CAST(0 AS DOUBLE) duration_min FROM l UNION ALL SELECT case_id, 'gap', 2 * rn - 1, -1, round((us - p) / 6e7, 1) FROM l WHERE us - p > 3600000000"),
    "timeline_summary": (lambda s, d: (lambda r: r.select("total_events", "gap_count", *us("first_ts", "last_ts"), "total_gap_minutes"))(timeline.summary(timeline.interleaved(tl(s, d), threshold_min=60))), f"{GAP} SELECT count(*) total_events, count(*) FILTER (us - p > 3600000000) gap_count, min(us) first_ts_us, max(us) last_ts_us, round(sum(CASE WHEN us - p > 3600000000 THEN round((us - p) / 6e7, 1) ELSE 0 END), 1) total_gap_minutes FROM l"),
    "timeline_counts": (lambda s, d: timeline.counts(tl(s, d), "severity", "category", "source"), f"{TL} SELECT 'severity' dimension, severity AS value, count(*) n FROM z GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM z GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM z GROUP BY 2"),
    "min_severity": (lambda s, d: timeline.at_least(tl(s, d), "High").select("seq", "severity"), f"{TL} SELECT seq, severity FROM z WHERE {RANK} >= 3"),
    "filtered_timeline": (lambda s, d: timeline.of_host(timeline.in_categories(timeline.between(tl(s, d), "2024-01-05 00:00:00", "2024-01-25 00:00:00"), ["authentication", "network"]), "HOST3").select("seq", "case_id"), f"{TL} SELECT seq, case_id FROM z WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND category IN ('authentication', 'network') AND host = 'host3'"),
    "case_filter": (lambda s, d: timeline.equal_text(timeline.of_case(tl(s, d), "CASE7"), "severity", " Low ").select("seq", "actor"), f"{TL} SELECT seq, actor FROM z WHERE case_id = 'case7' AND severity = 'low'"),
    "latest_events": (lambda s, d: timeline.ordered(tl(s, d), descending=True).select("seq", iso(F.col("ts")).alias("at")), f"{TL} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM z ORDER BY ts DESC, source DESC, action DESC"),
    "ordered_timeline": (lambda s, d: timeline.ordered(tl(s, d)).select("seq", iso(F.col("ts")).alias("at"), "source", "action"), f"{TL} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, source, action FROM z ORDER BY ts, source, action"),
    "latest_events_first": (lambda s, d: timeline.ordered(tl(s, d), descending=True).select("seq", iso(F.col("ts")).alias("at"), "source", "action"), f"{TL} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, source, action FROM z ORDER BY ts DESC, source DESC, action DESC"),
    "timeline_changes": (lambda s, d: diff.changes(*halves(s, d)).select("change", "seq", "source", "actor"), f"{DIFF} SELECT 'added' change, seq, source, actor FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME}) UNION ALL SELECT 'removed', seq, source, actor FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {SAME})"),
    "timeline_unchanged": (lambda s, d: diff.unchanged(*halves(s, d)), f"{DIFF} SELECT count(*) unchanged FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {SAME})"),
    "severity_deltas": (lambda s, d: longs(diff.deltas(*halves(s, d), "severity", ["low", "medium", "high", "unheard"])), f"{DIFF} SELECT v AS value, CAST((SELECT count(*) FROM b WHERE severity = v) AS BIGINT) AS before, CAST((SELECT count(*) FROM a WHERE severity = v) AS BIGINT) AS after, CAST((SELECT count(*) FROM a WHERE severity = v) - (SELECT count(*) FROM b WHERE severity = v) AS BIGINT) AS delta FROM (SELECT unnest(['low', 'medium', 'high', 'unheard']) v)"),
    "category_deltas": (lambda s, d: longs(diff.largest(diff.deltas(*halves(s, d), "category"))), f"{DIFF} SELECT category AS value, CAST(sum(x) AS BIGINT) AS before, CAST(sum(y) AS BIGINT) AS after, CAST(sum(y) - sum(x) AS BIGINT) AS delta FROM (SELECT category, 1 x, 0 y FROM b UNION ALL SELECT category, 0, 1 FROM a) GROUP BY 1"),
    "diff_totals": (lambda s, d: diff.totals(diff.changes(*halves(s, d))), f"{DIFF}, c AS (SELECT 1 added, severity FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME}) UNION ALL SELECT 0, severity FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {SAME})) SELECT count(*) total_changes, count(*) FILTER (added = 1) added, count(*) FILTER (added = 0) removed, coalesce(bool_or(added = 1 AND severity IN ('high', 'critical')), false) has_new_high_severity FROM c"),
    "attack_mapping": (lambda s, d: attack.mapped(tl(s, d)).select("seq", "technique_id", "tactic"), f"{MAPPED} SELECT seq, technique_id, tactic FROM q"),
    "attack_techniques": (lambda s, d: attack.techniques(attack.mapped(tl(s, d))), f"{MAPPED} SELECT technique_id, tactic, count(*) n FROM q WHERE technique_id IS NOT NULL GROUP BY 1, 2"),
    "top_tactics": (lambda s, d: attack.top(attack.mapped(tl(s, d)), "tactic", 3), f"{MAPPED} SELECT tactic, count(*) n FROM q WHERE tactic IS NOT NULL GROUP BY 1 ORDER BY n DESC, tactic LIMIT 3"),
    "attack_coverage": (lambda s, d: attack.coverage(attack.mapped(tl(s, d))), f"{MAPPED} SELECT count(*) total, count(technique_id) mapped, count(*) - count(technique_id) unmapped, round(100.0 * count(technique_id) / count(*), 1) coverage_pct, count(DISTINCT technique_id) techniques FROM q"),
    "attack_tagging": (lambda s, d: attack.tagged(tl(s, d).select("seq", (F.col("seq") % 4 + 4623).alias("event_id"), F.lit("PowerShell.exe").alias("process_name"), F.when(F.col("seq") % 2 == 0, "x").alias("command_line"))).select("seq", F.array_join("attack_tags", ",").alias("tags")), "SELECT event_id seq, CASE event_id % 4 WHEN 2 THEN 'T1110,T1059' WHEN 1 THEN 'T1078,T1059' ELSE 'T1059' END tags FROM events"),
    "detection_rules": (lambda s, d: rules.evaluate(tl(s, d), RULES).where("flagged").select("seq", F.array_join(F.transform("rule_matches", lambda m: F.concat_ws(":", m["title"], m["level"])), ";").alias("matches")), f"""{TL}, m AS (SELECT seq, concat_ws(';', CASE WHEN category = 'authentication' AND severity IN ('high', 'critical') THEN 'High failures:high' END, CASE WHEN action IN ('log_clear', 'cron_add') AND host = 'host3' THEN 'Either:low' END, CASE WHEN target IN ('target1', 'target2') THEN 'Any of:medium' END, CASE WHEN target = 'target3' AND host = 'host5' THEN 'All of:medium' END) matches FROM z) SELECT * FROM m WHERE matches <> ''"""),
    "indexed_rules": (
        lambda s, d: rule_index.evaluate(tl(s, d), MANY_RULES).where("flagged").select("seq", F.explode("rule_matches").alias("m")).groupBy("seq").agg(F.count("*").alias("n"), F.min("m.title").alias("first"), F.count_if(F.col("m.level") == "high").alias("high")),
        f"""{TL} SELECT seq, count(*) n, min(concat('R', i)) AS first, count(*) FILTER (i % 2 = 1) high FROM z JOIN (SELECT i, concat('host', i % 12) h, concat('target', i % 7) g, concat('user', i % 20) u, concat('10.0.0.', i % 200) a FROM range(3000) r(i)) ON host = h AND target = g AND (actor = u OR actor = a) AND (i % 3 = 0 OR severity = 'critical' AND category = 'system') GROUP BY seq""",
    ),
    "detection_rules_by_index": (lambda s, d: rule_index.evaluate(tl(s, d), RULES).where("flagged").select("seq", F.array_join(F.transform("rule_matches", lambda m: F.concat_ws(":", m["title"], m["level"])), ";").alias("matches")), None),
    "all_incidents": (lambda s, d: correlate.correlate(ev(s, d), window_s=DAY).groupBy("pattern", "severity").agg(F.count("*").alias("n"), F.sum("event_count").alias("events"), F.count_distinct("source_ip").alias("ips")), f"""{E}, w AS (SELECT *, count(*) FILTER (event_type = 'auth_fail') OVER v n FROM u WHERE event_type IN ('auth_fail', 'auth_success') WINDOW v AS (PARTITION BY source_ip ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq) r FROM w WHERE event_type = 'auth_success' AND n >= 5),
i AS (SELECT 'BRUTE_THEN_SUCCESS' pattern, 'CRITICAL' severity, n + 1 event_count, source_ip FROM b WHERE r = 1 UNION ALL SELECT pattern, severity, event_count, source_ip FROM ({_related(PRIV, "PRIVILEGE_ESCALATION", "HIGH", 0.8)}) UNION ALL SELECT pattern, severity, event_count, source_ip FROM ({_related(PERSIST, "PERSISTENCE", "HIGH", 0.75)})
UNION ALL SELECT pattern, severity, event_count, source_ip FROM ({_related(RECON.replace(f"{WEEK}000000", f"{DAY}000000"), "RECON_THEN_EXPLOIT", "CRITICAL", 0.85)}) UNION ALL SELECT 'ANOMALOUS_TIME', 'MEDIUM', 1, source_ip FROM u WHERE event_type = 'auth_success' AND hour(ts) NOT BETWEEN 7 AND 18
UNION ALL SELECT 'SPRAY_THEN_PIVOT', 'CRITICAL', n + 1, source_ip FROM (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq) r FROM (SELECT a.seq, a.source_ip, count(DISTINCT b.username) n FROM u a JOIN u b ON b.source_ip = a.source_ip AND b.event_type = 'auth_fail' AND b.us BETWEEN a.us - {DAY}000000 AND a.us WHERE a.event_type = 'auth_success' GROUP BY ALL HAVING count(DISTINCT b.username) >= 5)) WHERE r = 1)
SELECT pattern, severity, count(*) n, CAST(sum(event_count) AS BIGINT) events, count(DISTINCT source_ip) ips FROM i GROUP BY 1, 2"""),
    "incident_lines": (lambda s, d: correlate.summary_line(correlate.select_incidents(correlate.anomalous_time(ev(s, d)), username="user7")).select("seq", "summary"), f"{E} SELECT seq, concat('[MEDIUM] ANOMALOUS_TIME from ', source_ip, ': 1 events') summary FROM u WHERE event_type = 'auth_success' AND hour(ts) NOT BETWEEN 7 AND 18 AND username = 'user7'"),
    "united_sources": (lambda s, d: correlate.union_sources(correlate.normalized(raw_rows(s, d), "events"), correlate.normalized(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit(" user"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("login"), F.lit("LOGIN_FAILED").alias("type"), F.lit("").alias("src_ip")), "orders").drop("ts")).groupBy("source").agg(F.count("*").alias("n"), F.count("ts").alias("timed"), F.count_distinct("username").alias("users"), F.count_if(F.col("event_type") == "auth_fail").alias("failed")), "SELECT 'orders' source, count(*) n, CAST(0 AS BIGINT) timed, count(DISTINCT o_custkey) users, count(*) failed FROM orders UNION ALL SELECT 'events', count(*), count(ts), count(DISTINCT user_id), count(*) FILTER (event_id % 3 = 0) FROM events"),
    "without_gaps": (lambda s, d: timeline.without_gaps(timeline.interleaved(tl(s, d), threshold_min=60)).groupBy("case_id").agg(F.count("*").alias("n")), f"{TL} SELECT case_id, count(*) n FROM z GROUP BY 1"),
    "event_id_filter": (lambda s, d: timeline.with_service_name(timeline.with_event_ids(tl(s, d).withColumn("event_id", F.col("seq") % 3 + 7044), ["7045", "7046"]), "TARGET3").select("seq"), f"{TL} SELECT seq FROM z WHERE seq % 3 = 1 AND contains(target, 'target3')"),
    "added_by_category": (lambda s, d: diff.added_by_category(diff.changes(*halves(s, d))), f"{DIFF} SELECT category, count(*) added FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME}) GROUP BY 1"),
    "zoned_times": (lambda s, d: tl(s, d).select("seq", in_zone(F.col("ts"), "America/Sao_Paulo", F.col("raw")).alias("at")), f"{TL} SELECT seq, concat(strftime(ts - INTERVAL 3 HOURS, '%Y-%m-%dT%H:%M:%S'), '-03:00') AS at FROM z"),
}
QUERIES["detection_rules_by_index"] = QUERIES["detection_rules_by_index"][0], QUERIES["detection_rules"][1]
QUERIES["chains_through_host"] = (lambda s, d: movement.through_host(movement.chains(hops(s, d), window_s=WEEK), "HOST3").select("pattern", "source_ip", "hop_count", F.size("target_hosts").cast("long").alias("hosts"), "start_us"), f"""{SEQ}, m AS (SELECT *, min(us) OVER (PARTITION BY source_ip) f FROM hop)
SELECT CASE WHEN n >= 3 THEN 'MULTI_HOP_CHAIN' ELSE 'SEQUENTIAL_HOP' END pattern, source_ip, n hop_count, hosts, start_us FROM g JOIN (SELECT DISTINCT source_ip, chain FROM c WHERE target_host = 'host3') USING (source_ip, chain)
UNION ALL SELECT 'FAN_OUT', source_ip, count(*), count(DISTINCT target_host), min(us) FROM m WHERE us - f <= {WEEK}000000 GROUP BY source_ip HAVING count(DISTINCT target_host) >= 3 AND bool_or(target_host = 'host3')
UNION ALL SELECT 'CREDENTIAL_REUSE', arg_min(source_ip, (us, seq)), count(*), count(DISTINCT target_host), min(us) FROM hop GROUP BY username HAVING count(DISTINCT target_host) >= 2 AND bool_or(target_host = 'host3')""")
