"""The classifier: gradients, held-out accuracy, and rows that need a defined score."""

import math

import numpy as np
import pytest

from tracewright.llm import quality as q


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bag, y = np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(7, q.FEATURES))
    w = {k: np.array(v) for k, v in q.fit(x, bag, y, steps=1).items()}
    g = q.gradients(w, q.forward(w, x, bag), bag, y, 0.0)

    def loss(weights):
        s = q.forward(weights, x, bag)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k in ("E", "e", "V", "U", "a", "o", "b"):
        at = tuple(0 for _ in w[k].shape)
        up, down = np.array(w[k]), np.array(w[k])
        up[at] += 1e-6
        down[at] -= 1e-6
        assert np.array(g[k])[at] == pytest.approx((loss(w | {k: up}) - loss(w | {k: down})) / 2e-6, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = q.op2_quality(spark, sf).toPandas()
    both = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(scored, on="doc_id")
    test = both[both.held_out]
    assert len(scored) == 1000 and scored.score.between(0, 1).all() and len(test) > 80
    assert (test.quality == test.predicted).mean() > 0.95


def test_rows_with_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, "w " * 50_000), (5, "w " * 50_000), (None, "é日本 ☃"), (6, "ok text here.")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in texts], "doc_id long, text string, score double, passage int")
    labels = spark.createDataFrame([(6, 1), (5, 0), (4, None), (99, 1), (3, 7)], "doc_id long, quality int")
    weights = q.train(docs, labels)
    got = q.score(docs, weights).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert q.accepted(docs, weights).columns == docs.columns
    assert q.score(docs.limit(0), weights).count() == 0
    alone = q.train(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, alone).collect()} == {0.5}


def test_forward_by_loops():
    """Attention and score of each bag, one number after the other."""
    rng = np.random.default_rng(3)
    bag, x = np.array([0, 1, 5, 8]), rng.normal(size=(8, q.FEATURES))
    w = {k: np.array(v) for k, v in q.fit(x, bag, np.array([1.0, 0.0, 1.0]), steps=5).items()}
    got = q.forward(w, x, bag)
    for k, (a, b) in enumerate(zip(bag[:-1], bag[1:], strict=True)):
        hidden, logits = [], []
        for row in x[a:b]:
            z = [(row[i] - w["mean"][i]) / w["scale"][i] for i in range(q.FEATURES)]
            h = [math.tanh(sum(z[i] * w["E"][i, j] for i in range(q.FEATURES)) + w["e"][j]) for j in range(q.HIDDEN)]
            gate = lambda m, h=h: [sum(h[i] * m[i, j] for i in range(q.HIDDEN)) for j in range(q.GATE)]
            hidden.append(h)
            logits.append(sum(math.tanh(v) / (1 + math.exp(-u)) * c for v, u, c in zip(gate(w["V"]), gate(w["U"]), w["a"], strict=True)))
        raised = [math.exp(x) for x in logits]
        weight = [r / sum(raised) for r in raised]
        pooled = [sum(p * h[j] for p, h in zip(weight, hidden, strict=True)) for j in range(q.HIDDEN)]
        assert got["weight"][a:b] == pytest.approx(weight)
        assert got["score"][k] == pytest.approx(1 / (1 + math.exp(-(sum(p * o for p, o in zip(pooled, w["o"], strict=True)) + w["b"]))))


def test_labels_of_both_kinds_and_repeated_rows(spark):
    rows = [(i, ("good clean words of a text. " if i % 2 else "@@@ ### zz ") * 20, 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, *[rows[3]] * 30, (50, "", 1)], "doc_id long, text string, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (50, 1)], "doc_id long, quality int")
    one, two = (q.train(x, labels, sample=60, most=2) for x in (docs, docs.repartition(5)))
    assert all(np.array_equal(one[k], two[k]) for k in one)
    assert q.score(docs.where("doc_id = 50"), one).count() == 1


def test_passages_do_not_depend_on_their_neighbours():
    bare = lambda *texts: q.passages(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))
    for text in (b"", b" ", b"@@@ ### zz " * 90, b"a"):
        alone = bare(text)[0]
        for before, after in ((b"xx yy. ", b""), (b"", b"Qq zz"), (b"", b"")):
            x, bag = bare(before, text, after)
            assert np.array_equal(x[bag[1] : bag[2]], alone)


def test_fitted_texts_are_whole(spark, monkeypatch):
    """Texts are taken while their passages fit, none in part; those taken come with all their passages."""
    sizes = {k: 64 * (k % 7 + 1) - (k % 2) * 3 for k in range(60)} | {60: 64 * 500, 61: 0}
    docs = spark.createDataFrame([(k, " ".join(["word"] * n)) for k, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in sizes], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, bag, y: seen.append((len(x), np.diff(bag).tolist(), y.tolist())) or {})
    whole = {k: max(1, -(-n // 64)) for k, n in sizes.items()}
    import zlib

    allowed = [k for k in sizes if zlib.crc32(str(k).encode()) % 3 != 1]
    q.train(docs, labels, sample=100, most=100)
    assert seen[0][1] == [whole[k] for k in sorted(allowed, key=str)] and seen[0][2] == [k % 2 for k in sorted(allowed, key=str)]
    q.train(docs, labels, sample=50, most=2)
    assert seen[1][0] <= 100 and seen[1][0] >= 93 and set(seen[1][1]) <= set(whole.values()) - {500}
