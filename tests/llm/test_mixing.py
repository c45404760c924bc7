import numpy as np
import pytest

from tracewright.llm import mixing


def test_targets_stop_at_twice_a_source_and_reshare():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 300})
    assert list(got) and got["a"] == 20 and got["b"] == 200
    assert sum(got.values()) == pytest.approx(1.5 * 1410)
    assert got[None] / got["c"] == pytest.approx(1090 / 600 if got["c"] == 600 else 5)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    a = mixing.permuted(np.arange(n), n, 5)
    assert sorted(a.tolist()) == list(range(n))
    assert n < 17 or (a != mixing.permuted(np.arange(n), n, 6)).any()


def test_split_keeps_totals():
    totals = np.array([1000, 0, 37, 2])
    sizes = list(mixing.even(1039, 7))
    parts = list(mixing.split(totals, sizes, np.random.default_rng(1)))
    assert [int(p.sum()) for p in parts] == sizes and max(sizes) - min(sizes) <= 1
    assert sum(parts).tolist() == totals.tolist() and all((p >= 0).all() for p in parts)


def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["wörd"] * int(rng.integers(0, 300))), ["s1", "s0", None, "big", "big", "big"][i % 6], 1, 2) for i in range(600)]
    return spark.createDataFrame([*rows, (900, None, "s1", 1, 1), (901, "", "none", 1, 1), (902, "a " * 20_000, "s0", 1, 1), (None, "a b", "s1", 1, 1), (5, "x", "s1", 1, 1), (5, "x", "s1", 1, 1)], "doc_id long, text string, source string, k int, block int")


def test_mix_meets_targets_and_reruns_agree(spark):
    one = mixing.mix(docs(spark), shard_slots=100).toPandas()
    two = mixing.mix(docs(spark).repartition(7), shard_slots=100).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, one[key].itertuples(index=False))) == sorted(map(str, two[key].itertuples(index=False)))
    assert len(one) == docs(spark).count() and (one.taken <= 2 * one["size"]).all()
    by = one.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (by["size"] == by.index).all() and by.target.sum() == pytest.approx(1.5 * one["size"].sum())
    assert ((by.taken - by.target).abs() <= 0.01 * by.target + 2).all()


def test_permutations_of_many_sources_at_once():
    n = np.repeat([1, 5, 300], [1, 5, 300])
    at = np.concatenate([np.arange(k) for k in (1, 5, 300)])
    got = mixing.permuted(at, n, np.repeat([7, 8, 9], [1, 5, 300]))
    assert all(sorted(got[n == k].tolist()) == list(range(k)) for k in (1, 5, 300))
    assert (got[n == 300] == mixing.permuted(np.arange(300), 300, 9)).all()


def test_thousands_of_sources_are_dealt_in_bundles(spark):
    """Sources of every size and one that holds a third of all words: counts close, blocks differ, no task has all shards."""
    rng = np.random.default_rng(3)
    want = rng.integers(1, 60, 5000)
    want[17] = want.sum() // 2
    blocks = np.maximum(1, want // 2)
    drawn = mixing.slots(spark, want, blocks, shard_slots=500, seed=4, bundle=100)
    assert drawn.rdd.getNumPartitions() > 100
    got = drawn.toPandas()
    assert got.groupby("source").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert np.bincount(got.source, minlength=5000).tolist() == want.tolist()
    turns = got.assign(turn=got.slot // blocks[got.source])
    assert not turns.duplicated(["source", "turn", "block"]).any() and (got.block < blocks[got.source]).all()
    each = got.groupby("shard").slot.count()
    assert each.max() <= 1000 and (got[got.source == 17].groupby("shard").slot.count() / each).between(0.15, 0.55).mean() > 0.99


def test_mix_of_many_sources_and_a_very_long_text(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 2500}") for i in range(5000)] + [(9000, "long " * 2_000_000, "s0")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), bundle=300).toPandas()
    assert len(found) == 5001 and (found.taken <= 2 * found["size"]).all()
    assert abs(found.taken.sum() - 1.5 * found["size"].sum()) <= 0.01 * found["size"].sum() + 5000


def test_mixture_agrees_with_mix_and_stays_inside_documents(spark):
    slots = mixing.mixture(docs(spark)).toPandas()
    sizes = mixing.mix(docs(spark)).toPandas()
    assert slots.n.sum() == sizes.taken.sum() and (slots["first"] >= 0).all() and (slots.n <= 64).all()
    assert slots.groupby("shard").slot.count().max() <= 2 * mixing.SHARD_SLOTS


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_taken_words_by_loops(spark):
    """Documents end to end by source, every drawn block walked word by word."""
    placed, drawn, sizes, _ = mixing.plan(docs(spark), shard_slots=100)
    laid, words = {}, {}
    for r in placed.collect():
        for x in range(r["size"]):
            assert laid.setdefault((r.source, r["at"] + x), (r.doc_id, r["at"])) == (r.doc_id, r["at"])
        if r["size"]:
            words[r.k] = (r.source, r.length)
    assert all(sum(s == source for s, _ in laid) == n for source, n in sizes.items())
    taken: dict = {}
    for r in drawn.collect():
        source, length = words[r.source]
        for x in range(r.block * length, (r.block + 1) * length):
            if (source, x) in laid:
                key = (source, laid[source, x])
                taken[key] = taken.get(key, 0) + 1
    got = mixing.mix(docs(spark), shard_slots=100).groupBy("doc_id").agg({"taken": "sum"}).collect()
    want: dict = {}
    for (_, (doc_id, _)), n in taken.items():
        want[doc_id] = want.get(doc_id, 0) + n
    assert {r.doc_id: r[1] for r in got if r[1]} == want
