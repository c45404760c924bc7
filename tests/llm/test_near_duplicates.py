"""Classes and links against all pairs, on texts made of edits of each other."""

import random

import numpy as np
import pytest

from tracewright.llm import near_duplicates as nd
from tracewright.llm._graph import components, roots


def shingle_set(text, n=5):
    w = (text or "").lower().translate({c: 32 for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t in docs]
    links = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(docs))]
    out, seen = {}, set()
    for i in range(len(docs)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        low = min(docs[j][0] for j in group)
        out |= {docs[j][0]: (low, len(links[j])) for j in group}
    return out


def fixture(seed, group):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéÀß") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \n ", "one", "One", "a b c", "a b  C", "x " * 50]
    for size in [group, 3, 2, 8]:
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", "\n"]).join(w))
    texts += [texts[9], texts[9].upper(), texts[-1]]
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * k, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("seed", "group", "block"), [(1, 20, 192), (2, 60, 7)])
def test_links_and_classes(spark, monkeypatch, seed, group, block):
    blocked = nd.blocked
    monkeypatch.setattr(nd, "blocked", lambda df, key, size, *_: blocked(df, key, size, block))
    docs = fixture(seed, group)
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, row int, size int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(frame).collect()}
    assert got == brute(docs)
    kept = sorted(r.doc_id for r in nd.one_of_each(frame).collect())
    assert kept == sorted({c for c, _ in brute(docs).values()})


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (2, "q r s t u v"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((r.class_id or 0, r.n_links) for r in nd.near_duplicates(docs).collect()) == [(1, 2), (1, 2), (1, 2), (2, 0), (2, 0), (2, 0)]
    assert sorted((r.doc_id, r.text or "") for r in nd.one_of_each(docs).collect()) == [(1, "a b c d e f"), (2, ""), (2, ""), (2, "q r s t u v")]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs_and_drops_others():
    steps, rng = nd.least_matches(), np.random.default_rng(1)
    kept = {}
    for j in (0.3, 0.8, 0.9):
        sigs = rng.integers(0, 1 << 32, (4000, nd.HASHES), np.uint32)
        sigs[2000:] = np.where(rng.random((2000, nd.HASHES)) < j, sigs[:2000], sigs[2000:])
        kept[j] = len(nd.candidates(sigs, np.arange(2000), np.arange(2000, 4000), steps)) / 2000
    assert kept[0.3] < 0.01 and kept[0.8] > 0.999 and kept[0.9] == 1


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert roots(6, np.array([5, 4, 3]), np.array([4, 3, 1])).tolist() == [0, 1, 2, 1, 1, 1]


def test_very_long_texts(spark):
    """Texts of over a megabyte that differ in a few words, and one that differs in many."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    near, far = list(base), [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    near[::9000] = ["changed"] * len(near[::9000])
    docs = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate((base, near, far))], "doc_id long, text string, row int")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in nd.near_duplicates(docs).collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]
