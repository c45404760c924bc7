"""Histogram sort against a walk over the ordered rows, and the cases that have to have a defined result."""

import random
from collections import defaultdict

import pytest

from tracewright.llm import sharding

SCHEMA = "doc_id long, text string, shard int, slot string, size int, row int"


def fixture(seed: int, n: int = 400) -> list[tuple[int | None, str | None]]:
    """Texts of many lengths; a third of all rows are copies of one, and there are small groups, nulls and a long text."""
    rng = random.Random(seed)
    texts = ["é" * rng.randint(0, 200) + str(rng.random()) for _ in range(n // 2)]
    texts += ["the same text " * 9] * (n // 3) + [t for t in texts[:20] for _ in range(3)] + [None, "", None, "long " * 3000]
    return [(None if k == 7 else k, t) for k, t in enumerate(texts)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize(("seed", "shards", "tolerance"), [(1, 7, 0.01), (2, 40, 0.01), (3, 3, 0.5), (4, 1, 0.01)])
def test_shards_equal_a_walk(spark, seed, shards, tolerance):
    docs = fixture(seed)
    got = sharding.sharded(frame(spark, docs), shards=shards, tolerance=tolerance, piece=10).select("row.doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got))) == sorted(map(str, sharding.brute_force(docs, shards, tolerance)))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_and_copies_stay_together_where_they_can(spark):
    docs = [(i, t) for i, t in fixture(5, 3000) if t is None or len(t) < 5000]
    got = sharding.sharded(frame(spark, docs), shards=8).select("row.text", "size", "shard").collect()
    sizes, where = defaultdict(int), defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        where[r.text].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and all(abs(s - mean) <= 0.02 * mean + 500 for s in sizes.values())
    assert len(where["the same text " * 9]) > 1 and sum(len(x) > 1 for t, x in where.items() if t and not t.startswith("the same")) == 0


def test_edge_tables(spark):
    empty = sharding.sharded(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["shard", "slot", "size", "text_crc32", "row"]
    alike = sharding.sharded(frame(spark, [(1, "a")] * 20), shards=4).collect()
    assert len({r.shard for r in alike}) == 1 and sorted(r.slot for r in alike) == list(range(20))
    few = sharding.sharded(frame(spark, [(1, None), (2, ""), (None, "x")]), shards=40).collect()
    assert len(few) == 3 and sorted(r["size"] for r in few) == [16, 16, 17]
    assert few[0]["row"].asDict().keys() == {"doc_id", "text", "shard", "slot", "size", "row"}


def test_written_shards(spark, tmp_path):
    sharding.write_shards(frame(spark, fixture(6)), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(fixture(6)) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_no_python_and_one_exchange_of_rows(spark):
    plan = sharding.sharded(frame(spark, fixture(7)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
