"""Stateful streams: late rows, restarts from a checkpoint, incidents that are overtaken; equality with batch on whole tables is in test_queries."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright.operators import correlate, movement, timeline
from tracewright.streaming import ordered

EVENT = "seq long, ts timestamp, source string, event_type string, source_ip string, username string, hostname string"
T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def random_events(seed: int, n: int = 600) -> list[tuple]:
    """Events of few addresses within some hours, many of them at equal times."""
    rng = random.Random(seed)
    kinds = ["auth_fail"] * 5 + ["auth_success", "net_scan", "exploit", "user_add", "sudo"]
    return [(k, at(rng.randrange(0, 20_000, 5)), rng.choice(["a", "b", None]), rng.choice(kinds), rng.choice(["1.1.1.1", "2.2.2.2", "", None]), rng.choice(["u", "v", "w", ""]), rng.choice(["h1", "h2", "h3"])) for k in range(n)]


class Replay:
    """A folder that a stream reads, its output and its checkpoint."""

    def __init__(self, spark, path, stream, schema=EVENT):
        self.spark, self.path, self.stream, self.schema = spark, str(path), stream, schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        """Takes up what has come since, as after a restart."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        ordered.write_changes(self.stream(source), f"{self.path}/out", f"{self.path}/checkpoint", availableNow=True).awaitTermination()
        return ordered.read_changes(self.spark, f"{self.path}/out")


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("rule", ["brute_then_success", "spray_then_pivot", "recon_then_exploit"])
def test_incidents_over_shuffled_files_late_rows_and_a_restart(spark, tmp_path, rule):
    events, options = random_events(1), {"brute_then_success": {"fails": 3, "window_s": 300}, "spray_then_pivot": {"users": 3, "window_s": 300}, "recon_then_exploit": {"window_s": 5000}}[rule]
    replay = Replay(spark, tmp_path, lambda x: getattr(ordered, rule)(x, late="100 minutes", **options))
    by_time = sorted(events, key=lambda e: e[1] + datetime.timedelta(seconds=e[0] % 7 * 600))
    for k in range(0, 400, 200):
        replay.add(by_time[k : k + 200])
    replay.run()
    late = [(9000 + k, at(k), "z", kind, "1.1.1.1", f"late{k}", "h") for k, kind in enumerate(["auth_fail"] * 5 + ["auth_success", "net_scan", "exploit"])]
    replay.add([*by_time[400:], (10_000, at(500_000), "end", "end", "x", "x", "x")])
    replay.run()
    replay.add([*late, (10_001, at(600_000), "end", "end", "x", "x", "x")])
    got = ordered.standing(replay.run())
    want = getattr(correlate, rule)(spark.createDataFrame(events, EVENT), **options)
    assert want.count() and rows(got, correlate.OUT) == rows(want, correlate.OUT)


def test_persistence_and_chains_over_shuffled_files(spark, tmp_path):
    events = random_events(2, 150)
    mixed = sorted(events, key=lambda e: (e[1] + datetime.timedelta(seconds=e[0] % 5 * 500), e[0]))
    end = (10_000, at(500_000), "end", "end", "x", "x", "x")
    replay = Replay(spark, tmp_path / "p", lambda x: ordered.persistence(x, window_s=3000, late="60 minutes"))
    for part in (mixed[:75], [*mixed[75:], end]):
        replay.add(part)
    want = correlate.persistence(spark.createDataFrame(events, EVENT), window_s=3000)
    assert want.count() and rows(replay.run(), correlate.OUT) == rows(want, correlate.OUT)
    hops = movement.hops(spark.createDataFrame(events, EVENT), blob=F.lit(""))
    table = [tuple(r) for r in hops.orderBy("ts").collect()]
    replay = Replay(spark, tmp_path / "h", lambda x: ordered.sequential(x, window_s=900, late="60 minutes"), hops.schema)
    for part in (table[::2], [*table[1::2], (10_000, at(500_000), "x", "x", "x")]):
        replay.add(part)
    want = movement.sequential(hops, window_s=900)
    assert want.count() and rows(replay.run(), want.columns) == rows(want, want.columns)


def test_gaps_and_interleaved_of_ties_and_null_keys(spark, tmp_path):
    schema = "seq long, case_id string, ts timestamp, source string, action string"
    rng = random.Random(3)
    events = [(k, rng.choice(["c", "d", None]), at(rng.randrange(0, 9000, 60)), rng.choice(["s", "t"]), rng.choice(["x", "y"])) for k in range(90)]
    events = list({(e[1], e[2], e[3], e[4]): e for e in events}.values())  # what ties in all is in any order
    for name, make, want in (
        ("gaps", lambda x: ordered.gaps(x, threshold_s=300, late="3 hours"), timeline.gaps(spark.createDataFrame(events, schema), threshold_s=300)),
        ("interleaved", lambda x: ordered.interleaved(x, threshold_min=5, late="3 hours"), timeline.interleaved(spark.createDataFrame(events, schema), threshold_min=5)),
    ):
        replay = Replay(spark, tmp_path / name, make, schema)
        replay.add(events[::2])
        replay.add(events[1::2])
        replay.add([(999, "c", at(900_000), "s", "x")])
        assert want.count() and rows(replay.run(), want.columns) == rows(want, want.columns)


def scan(seq, us, kind):
    return Row(us=us, seq=seq, event_type=kind, source="s", username="u")


def test_a_newer_scan_takes_an_incident_back():
    step = ordered.LastScan(100, 2)
    out, kept = step.rows(("ip",), None, [scan(1, 0, "net_scan"), scan(5, 10, "exploit"), scan(4, 20, "exploit"), scan(3, 30, "exploit"), scan(9, 200, "exploit")])
    assert [(r[3], r[6], r[-1]) for r in out] == [(1, 2, 1), (1, 3, 2), (1, 3, 3)] and [r[0] for r in kept[4]] == [3, 4]
    out, kept = step.rows(("ip",), kept, [scan(0, 300, "net_scan")])
    assert out == [] and kept[0] == 1
    out, kept = step.rows(("ip",), kept, [scan(7, 400, "net_scan")])
    assert [(r[3], r[6], r[-1]) for r in out] == [(1, 0, 4)] and kept[:2] == (7, 400) and kept[4] == []


def test_memory_of_failures_is_one_window():
    step = ordered.AfterFailures("P", 100, 2, users=False, base=0.5, step=0.1, most=0.9)
    fails = [Row(us=k * 10, seq=k, event_type="auth_fail", source="s", username="u") for k in range(50)]
    login = Row(us=490, seq=99, event_type="auth_success", source="s", username="u")
    out, kept = step.rows(("ip",), None, [*fails, login])
    assert len(kept[0]) == 11 and out[0][6] == 12 and step.due(kept) == 590
    assert step.closed(("ip",), kept, 600) == ([], ([], 99, 1)) and step.closed(("ip",), (kept[0], None, 0), 600) == ([], None)
    out, kept = step.rows(("ip",), kept, [Row(us=491, seq=100, event_type="auth_success", source="s", username="u")])
    assert out == []
    out, kept = step.rows(("ip",), kept, [Row(us=492, seq=50, event_type="auth_success", source="s", username="u")])
    assert [(r[3], r[-1]) for r in out] == [(50, 2)]


def test_a_row_later_than_all_but_the_window_of_a_second_is_the_last(spark, tmp_path):
    schema = "seq long, ts timestamp, source string, actor string, target string, action string"
    replay = Replay(spark, tmp_path, lambda x: ordered.deduplicated(x, late="1 minute"), schema)
    replay.add([(1, at(0.2), "s", "a", "t", "X"), (2, at(0.9), "s", "a", "t", " x"), (3, at(1.1), "s", "a", "t", "x"), (4, at(0.1), "s", None, None, None)])
    replay.add([(5, at(0.0), "s", "a", "t", "x"), (6, at(300), "s", "a", "t", "x")])
    replay.run()
    replay.add([(7, at(0.5), "s", "a", "t", "x"), (8, at(900), "s", "a", "t", "x")])  # the first is late
    assert sorted(r.seq for r in replay.run().collect()) == [3, 4, 5, 6]
