"""Links and components of embeddings against all pairs."""

import math

import numpy as np
import pytest

from tracewright.llm import embedding_dedup as e
from tracewright.llm._graph import roots

SCHEMA = "vec_id long, embedding array<float>, label int, row int, v string"


def brute(rows, threshold=0.98):
    ok = [x is not None and lab is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x) for _, x, lab in rows]
    n, links = len(rows), np.zeros((len(rows), len(rows)), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                links[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold
    root = roots(n, *np.nonzero(links))
    low = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in set(root.tolist())}
    return sorted((rows[i][0], int(links[i].sum()), low[root[i]]) for i in range(n))


def fixture(group):
    rng = np.random.default_rng(5)
    rows = []
    for size in (group, 5, 3, 2):
        centre = rng.normal(size=16)
        rows += [(centre + 0.06 * rng.normal(size=16), 1) for _ in range(size)]
    rows += [(rng.normal(size=16), int(rng.integers(0, 3))) for _ in range(60)]
    rows += [(rows[0][0], 1), (rows[0][0], 2), (2 * rows[0][0], 1)]
    out = [(int(k), x.astype(np.float32).tolist(), lab) for k, (x, lab) in zip(rng.permutation(len(rows)), rows, strict=True)]
    return [*out, (1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, out[0][1], None), (1005, [], 1), (1006, [1.0, 0.0], 1), (1007, [1.0, 0.01], 1)]


@pytest.mark.parametrize(("group", "block", "most"), [(12, 256, 32), (70, 16, 8)])
def test_links_and_components(spark, group, block, most):
    rows = fixture(group)
    frame = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3)
    got = e.near_embeddings(frame, block=block, most=most).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert e.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: r.n_links for r in e.op8_embedding_dedup(spark, sf).collect()}
    want = {v: n for v, n, _ in brute(rows)}
    assert all(got[v] <= want[v] for v in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_links_between_tight_groups(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(12):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for centre in (a, math.cos(0.15) * a + math.sin(0.15) * b):
            rows += [(centre + 0.003 * rng.normal(size=32)).astype(np.float32).tolist() for _ in range(40)]
    rows = [(i, x, 1) for i, x in enumerate(rows)]
    got = e.near_embeddings(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def scattered():
    rng, rows = np.random.default_rng(4), []
    for size in (200, *[2] * 8):
        centre = rng.normal(size=16)
        rows += [(centre + 0.06 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(size)]
    return [(i, x, 1) for i, x in enumerate(rows)]


def test_audit_sees_small_groups(spark):
    rows = scattered()
    want = {v: n for v, n, _ in brute(rows)}
    frame = e.vectors(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), "vec_id", "embedding", "label")
    ids = {r.row: r.vec_id for r in frame.collect()}
    reps = frame.selectExpr("row", "label", "v", "1L as copies")
    large = spark.createDataFrame([(r, want[v], r) for r, v in ids.items() if v < 200 and want[v]], "row long, links long, root long")
    assert sum(n for v, n in want.items() if v < 200) > 0.99 * sum(want.values())
    assert e.audit(reps, large, threshold=0.98) < 0.97
    every = spark.createDataFrame([(r, want[v], r) for r, v in ids.items() if want[v]], "row long, links long, root long")
    assert e.audit(reps, every, threshold=0.98) == 1.0


def test_short_recall_ends_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(e, "refine", lambda edges, reps, **_: edges.limit(0))
    rows = scattered()
    got = e.near_embeddings(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), rounds=1).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_no_label_at_all(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0], None, 0, "") for i in range(5)], SCHEMA)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_embeddings(frame).collect()) == [(i, 0, i, True) for i in range(5)]


def test_dense_and_loose_components(spark):
    """A ball that is only counted, with rows beyond half the angle, copies, and one of too wide an angle; small blocks."""
    rng, rows = np.random.default_rng(8), []
    centre = rng.normal(size=24)
    for spread, size in ((0.01, 150), (0.04, 60), (0.07, 40)):
        rows += [(centre + spread * rng.normal(size=24) * np.linalg.norm(centre) / 5).astype(np.float32).tolist() for _ in range(size)]
    rows += [rows[3], rows[3], rows[200]]
    rows = [(i, x, 1 + (i % 97 == 0)) for i, x in enumerate(rows)]
    want = brute(rows)
    assert 10_000 < sum(n for _, n, _ in want) < 250 * 250
    for block in (16, 256):
        got = e.near_embeddings(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3), block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def bucketed(spark, rows, bits):
    frame = e.vectors(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(4), "vec_id", "embedding", "label")
    reps = frame.selectExpr("row", "label", "v", "1L as copies")
    return frame, reps, e.sided(reps, bits, 2, 1)


def test_groups_are_buckets_and_none_exceeds_two_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x.astype(np.float32).tolist(), 1 + i % 2) for i, x in enumerate(rng.normal(size=(3000, 16)))]
    _, reps, sides = bucketed(spark, rows, 8)
    dealt = e.centred(sides, ["t", "label", "side"], 256).groupBy("k").count().collect()
    assert len(dealt) == sides.select("t", "label", "side").distinct().count() > 500 and max(r["count"] for r in dealt) <= 256
    alike = [(i, [1.0, 2.0 + i * 1e-6], 1) for i in range(3000)]
    _, reps, sides = bucketed(spark, alike, 8)
    dealt = e.centred(sides.where("t = 0"), ["t", "label", "side"], 256).groupBy("k").count().collect()
    assert len(dealt) >= 12 and max(r["count"] for r in dealt) <= 512 and sum(r["count"] for r in dealt) <= 3000 + len(dealt)


def test_planes_grow_with_the_table():
    bits, tables = e.planes(200, 0.98, 256)
    assert bits == e.BITS and 4 <= tables <= 6
    for n in (10_000, 1_000_000, 10**9):
        bits, tables = e.planes(n, 0.98, 256)
        assert n / 2**bits <= 128 and 1 - (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables >= 0.98


def test_planes_apart_see_missed_rare_pairs(spark):
    """Nothing found of ten pairs among thousands of vectors is not a recall of one."""
    rng, rows = np.random.default_rng(2), []
    for _ in range(10):
        centre = rng.normal(size=16)
        rows += [centre, centre + 0.05 * rng.normal(size=16)]
    rows = [(i, x.astype(np.float32).tolist(), 1) for i, x in enumerate([*rows, *rng.normal(size=(2000, 16))])]
    _, reps, _ = bucketed(spark, rows, 8)
    reps = e.cut(reps)
    apart = e.cut(e.compared(e.sided(reps, *e.planes(2020, 0.98, 256), 5), ["t", "label", "side"], reps, e.NEIGHBOURS, e.FLOOR, 0.98, 256))
    assert e.known_share(apart.limit(0), apart) == 0.0 and e.known_share(apart, apart) == 1.0
    assert e.known_share(apart.limit(0), apart.limit(0)) == 1.0


def test_recall_over_rare_pairs_of_a_large_label(spark):
    rng = np.random.default_rng(6)
    pairs = rng.normal(size=(300, 32))
    x = np.concatenate([pairs, pairs + 0.15 * rng.normal(size=(300, 32)), rng.normal(size=(5400, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, 0)
    want = (like >= 0.98).sum(axis=1)
    assert want.sum() > 200
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r.n_links for r in e.near_embeddings(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(4)).collect()}
    assert sum(min(got[i], n) for i, n in enumerate(want)) >= 0.97 * want.sum()
