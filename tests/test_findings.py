"""Findings of a review: each test failed before its mend."""

import datetime
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import Row

from tracewright.plans.registry import QUERIES
from tracewright.sources import records
from tracewright.streaming import ordered

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def test_gaps_are_counted_where_there_are_none(spark, tmp_path):
    events = [(k, START + datetime.timedelta(minutes=k), 7, "error", 50.0, '{"k": 3}') for k in range(5)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    query, sql = QUERIES["export_ecs"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and ("timeline_gap", "state", "-", "-", "-", 0) in want


def test_many_files_are_written_by_tasks_and_hashed(spark, tmp_path):
    rows = [(f"{k % 3}/name {k}%20", "x" * k if k else None) for k in range(40)]
    records.write_files(spark.createDataFrame(rows, "path string, content string").repartition(5), f"{tmp_path}/in")
    want = {path: hashlib.sha256((content or "").encode()).hexdigest() for path, content in rows}
    for most in (1 << 26, -1):
        assert {r.path: r.sha256 for r in records.evidence(spark, f"{tmp_path}/in", most=most).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_rows_that_follow_a_head_over_two_slots(seed):
    """Equal times and seqs, repeated rows and missing sources, against all pairs."""
    rng = random.Random(seed)
    rows = [(rng.randrange(100, 300), rng.random() < 0.7, rng.randrange(40), rng.choice(["a", "", None]), "ip", "u") for _ in range(120)]
    key = lambda r: (r[2], r[0], r[3] is not None, r[3] or "")
    want = []
    for head in rows:
        near = sorted({key(r) for r in rows if r[1] and head[0] <= r[0] <= head[0] + 100})[:3]
        if not head[1] and head[0] < 200 and near:
            want.append((head, near))
    assert want and sorted(map(str, ordered.first_following([*rows], 100, 100, 3))) == sorted(map(str, want))


def test_streams_make_no_pairs_and_no_row_waits_in_python(spark, tmp_path):
    events = spark.createDataFrame([(1, START, "s", "auth_fail", "ip", "u", "h")], "seq long, ts timestamp, source string, event_type string, source_ip string, username string, hostname string")
    events.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    assert "Join" not in ordered.persistence(source)._jdf.queryExecution().analyzed().toString()
    for stream in (ordered.brute_then_success, ordered.spray_then_pivot, ordered.recon_then_exploit):
        plan = stream(source)._jdf.queryExecution().analyzed().toString()
        assert plan.index("TransformWithState") < plan.index("Aggregate") < plan.index("collect_list")


class Cell:
    """A state of one value or, by key, of many; the most it held is kept."""

    def __init__(self):
        self.value, self.values, self.most = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):  # noqa: N802
        self.values[key] = value
        self.most = max(self.most, len(self.values))

    def getValue(self, key):  # noqa: N802
        return self.values[key]

    def removeKey(self, key):  # noqa: N802
        del self.values[key]


def test_slots_hand_on_a_count_and_a_time_in_any_order():
    step = ordered.HandedOn()
    step.kept, step.texts = Cell(), Cell()
    slot = lambda first, last, n: Row(first=first, last=last, n=n, rows=f"text {first}")
    out = list(step.handleInputRows(("c",), iter([slot(50, 59, 3), slot(10, 10, 1), slot(20, 29, 2)]), None))
    assert [(r.before, r.nth, r.rows) for r in out] == [(None, 0, "text 10"), (10, 1, "text 20"), (29, 3, "text 50")]
    assert step.texts.most == 3 and not step.texts.values and step.kept.value == (59, 6)
    assert [(r.before, r.nth) for r in step.handleInputRows(("c",), iter([slot(70, 71, 2)]), None)] == [(59, 6)]
