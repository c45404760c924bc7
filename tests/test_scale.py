"""Stored timelines, evidence of any size, indexed rules and busy keys."""

import datetime
import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tracewright.operators import correlate, movement, rule_index, rules
from tracewright.sources import records, timelines

EVENT = "seq long, case_id string, ts timestamp, host string, severity string"


def stored(spark, tmp_path):
    day = lambda k: datetime.datetime(2026, 1, 1 + k % 5, 23, 59, 59, 999_999, tzinfo=datetime.UTC)
    rows = [(k, ["007", "7 ", "Case", None][k % 4], None if k % 9 == 0 else day(k), ["H1", "h1 ", "h2", None, "42"][k % 5], "low") for k in range(180)]
    events = spark.createDataFrame(rows, EVENT)
    timelines.write_timeline(events, str(tmp_path / "t"), hosts=3)
    return rows, events, str(tmp_path / "t")


def test_stored_timeline_is_whole_and_reads_only_what_it_has_to(spark, tmp_path):
    rows, events, path = stored(spark, tmp_path)
    back = timelines.read_timeline(spark, path)
    assert back.columns == ["seq", "case_id", "ts", "host", "severity"] and sorted(map(str, back.collect())) == sorted(map(str, events.collect()))
    files = set(back.inputFiles())

    def read(**options):
        found = timelines.read_timeline(spark, path, **options)
        scanned = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
        return sorted(r.seq for r in found.collect()), found, " ".join(scanned)

    got, found, plan = read(case_id="CASE")
    assert got == [r[0] for r in rows if r[1] == "Case"] and "case_key" in plan
    read_files = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("case_key=case/" in r.f for r in read_files) and len(read_files) < len(files)
    assert read(case_id="007")[0] == [r[0] for r in rows if r[1] == "007"]
    got, found, plan = read(since="2026-01-02", until="2026-01-03T12:00:00Z")
    assert got == [r[0] for r in rows if r[2] is None or r[2].day == 2] and "day" in plan
    assert {r.f.split("day=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect()} <= {"2026-01-02", "2026-01-03", "__HIVE_DEFAULT_PARTITION__"}
    got, found, plan = read(host=" H1")
    assert got == [r[0] for r in rows if r[3] in ("H1", "h1 ")] and "host_of_3" in plan
    assert len({r.f.split("host_of_3=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect()}) == 1
    assert read(case_id="none")[0] == []
    with pytest.raises(ValueError, match="either"):
        timelines.write_timeline(events.withColumn("hostname", F.lit("x")), path)


def test_evidence_of_any_size_in_chunks(spark, tmp_path):
    with (tmp_path / "disk image.raw").open("wb") as f:
        f.truncate(1 << 30)
        f.seek(123_456_789)
        f.write(b"evidence")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "integrity_manifest.json").write_text("{}")
    tracemalloc.start()
    digest = records.sha256_of(f"file:{tmp_path}/disk image.raw")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    with (tmp_path / "disk image.raw").open("rb") as f:
        assert digest == hashlib.file_digest(f, "sha256").hexdigest() and peak < 10 << 20
    got = {r.path: r.sha256 for r in records.evidence(spark, str(tmp_path)).collect()}
    assert got == {"disk image.raw": digest, "note.txt": hashlib.sha256(b"x").hexdigest(), "empty": hashlib.sha256(b"").hexdigest()}
    assert {r.path: r.sha256 for r in records.evidence(spark, str(tmp_path), most=-1).collect()} == got


def many_rules(seed: int, n: int) -> list[dict]:
    """Rules of all forms: texts, lists, numbers, null, missing fields, several maps, chains, "1 of", "all of", and faulty ones."""
    rng = random.Random(seed)
    wanted = {"host": lambda: rng.choice(["h0", "h1", ["h1", "h2"], None, "None", [None, "h3"]]), "port": lambda: rng.choice([22, [22, 80], "22", None, 443]), "ok": lambda: rng.choice([True, "true", [False]]), "gone": lambda: rng.choice(["None", None, "x", [None]])}
    conjunction = lambda: {f: wanted[f]() for f in rng.sample(list(wanted), rng.randint(0, 3))}
    selection = lambda: rng.choice([conjunction, lambda: [conjunction() for _ in range(rng.randint(0, 3))], lambda: "odd"])()
    out = []
    for k in range(n):
        detection = {name: selection() for name in ("sel_a", "sel_b", "other")}
        detection["condition"] = rng.choice(["sel_a", "sel_a and sel_b", "sel_a or sel_b and other", "1 of sel*", "all of sel_*", "all of none*", "1 of other", "", "missing", "sel_a AND missing or other", "and"])
        out.append({"title": f"R{k}", "detection": detection} | ({"level": "high"} if k % 3 else {}))
    return [*out, {"title": "no detection"}, {"detection": {"sel_a": {"host": "h1"}, "condition": "sel_a"}}]


def test_indexed_rules_equal_expressions(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["h0", "h1", "h2", "h3", None, "None"]), rng.choice([22, 80, 443, None]), rng.choice([True, False, None]), "kept") for k in range(120)]
    events = spark.createDataFrame(rows, "seq long, host string, port int, ok boolean, flagged string")
    some = many_rules(6, 240)
    told = lambda df: {r.seq: ([(m.title, m.level) for m in r.rule_matches], r.flagged) for r in df.collect()}
    got = told(rule_index.evaluate(events, some))
    want: dict = {}
    for k in range(0, len(some), 60):
        for seq, (matches, _) in told(rules.evaluate(events, some[k : k + 60])).items():
            want[seq] = want.get(seq, []) + matches
    assert got == {seq: (m, bool(m)) for seq, m in want.items()} and any(m for m in want.values())
    assert told(rule_index.evaluate(events, [])) == {k: ([], False) for k in range(120)}


def test_three_thousand_rules_and_a_small_memory():
    index = rule_index.Index([{"title": f"R{k}", "detection": {"sel": {"host": f"h{k}"}, "condition": "sel"}} for k in range(20_000)])
    for k in range(0, 20_000, 3):
        assert index.matches(tuple(x for x in (k,) if np_bit(index.satisfied("host", f"h{k}", f"h{k}"), x))) == ((f"R{k}", "medium"),)
    assert len(index.cached) <= rule_index.CACHED and len(index.judged) <= rule_index.CACHED
    assert index.satisfied("host", "other", "other") is index.free["host"]


def np_bit(bits, k):
    return bits[k // 8] >> (7 - k % 8) & 1


def test_hops_of_one_busy_address_are_summed_up_before_they_meet(spark):
    hour = F.lit("2026-01-01").cast("timestamp")
    hops = spark.range(200_000).select(F.col("id").alias("seq"), (hour + F.expr("make_interval(0, 0, 0, 0, 0, 0, id)")).alias("ts"), F.lit("unknown").alias("source_ip"), F.concat(F.lit("h"), F.col("id") % 5).alias("target_host"), F.concat(F.lit("u"), F.col("id") % 3).alias("username"))
    untimed = hops.limit(10).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("target_host", F.lit("untimed"))
    fan = movement.fan_out(hops.unionByName(untimed)).collect()
    assert [(r.hop_count, r.target_hosts, r.usernames) for r in fan] == [(3601 + 10, ["h0", "h1", "h2", "h3", "h4", "untimed"], ["u0", "u1", "u2"])]
    reuse = {r.usernames[0]: r.hop_count for r in movement.credential_reuse(hops).collect()}
    assert sum(reuse.values()) == 200_000 and set(reuse) == {"u0", "u1", "u2"}
    # what comes together of an address or user has a row a host, not a row a hop
    plan = movement.credential_reuse(hops)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Window" not in movement.fan_out(hops)._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_unknown_addresses_meets_in_slots(spark):
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    rows = [(k, start + datetime.timedelta(seconds=100 * k), "s", "auth_success" if k == 12 else "auth_fail", None, "u", "h") for k in range(30)]
    events = spark.createDataFrame(rows, "seq long, ts timestamp, source string, event_type string, source_ip string, username string, hostname string")
    found = correlate.brute_evidence(events, correlate.brute_then_success(events))
    assert sorted(r.seq for r in found.collect()) == [6, 7, 8, 9, 10, 11]
    assert "slot" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_one_head_of_a_busy_key_meets_its_rows_once(spark, seed):
    """A third of all rows follow one head; equal times, equal seqs and repeated rows; the same as over slots."""
    rng = random.Random(seed)
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    of = lambda k: rng.choice(["", "unknown", f"a{k % 40}"])
    row = lambda k: (rng.randrange(900), of(k), f"u{k % 7}", "s", start + datetime.timedelta(seconds=rng.randrange(3000)))
    names = "seq long, source_ip string, username string, source string, ts timestamp"
    later = [row(k) for k in range(2000)]
    timed = lambda rows: spark.createDataFrame(rows, names).withColumn("us", F.unix_micros("ts"))
    once = {r[1]: r for r in (row(k) for k in range(300))}.values()
    heads, rows = timed(list(once)), timed([*later, *later[:200]])
    found = correlate.followed_once(heads, rows, "source_ip", window_s=600)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, found.select("seq", "us", "source_ip", "related").collect()))
    assert got and got == sorted(map(str, correlate.followed(heads, rows, ["source_ip"], window_s=600).select("seq", "us", "source_ip", "related").collect()))
