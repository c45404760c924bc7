"""Byte and word passages against brute force, and the cases that have to have a defined result."""

import hashlib
import random

import numpy as np
import pytest

from tracewright.llm import _arrays as A
from tracewright.llm import _passages, decontaminate, substring_dedup, suffix_dedup
from tracewright.llm._suffix import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, n int, start int, words string"


def fixture(seed: int) -> list[tuple[int, str | None]]:
    """Texts that share passages, with nulls, empty ones, copies, ties and a long one."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "Ça", "dd", "éé", "f\x00g", "x,", "日本", "z"])
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(5)]
    texts: list[str | None] = [None, "", " \t\n", "a", " ".join(["same"] * 90), " ".join(["same"] * 90)]
    for _ in range(30):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  ", ""]).join(parts))
    texts += [texts[8], texts[9], texts[8], "q " * 3000 + (texts[10] or "")]
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(80):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 70)), 0)
        order = suffix_array(t)
        expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert order.tolist() == expected
        lcp = common_prefixes(t.astype(np.uint8), order, np.zeros(0, np.int64), 100)
        for a, b in zip(expected, expected[1:], strict=False):
            n = 0
            while t[a + n] == t[b + n]:
                n += 1
            assert lcp[b] == n


def test_suffix_array_of_words():
    rng = np.random.default_rng(4)
    for n in (500, 4000):
        t = np.append(np.concatenate([rng.permutation([5, 9, 9, 7, 8, 6])[: rng.integers(2, 7)] for _ in range(n)]), 0)
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i : i + 300].tolist())


def test_hashes_over_several_tiles():
    data = np.tile(np.frombuffer(b"some words of text ", np.uint8), A.TILE // 19 * 3)
    starts, ends, _ = A.word_bounds(data, np.array([0, len(data)]), A.word_table(lower_ascii_words=False))
    assert len(np.unique(A.word_hashes(data, starts, ends))) == 4
    assert len(np.unique(A.Prefix(data, A.BASE_WORDS).all(19))) == 19


@pytest.mark.parametrize(("seed", "length", "k", "hot"), [(1, 60, 8, 1000), (2, 25, 4, 2), (3, 40, 16, 1)])
def test_repeated_bytes(spark, monkeypatch, seed, length, k, hot):
    monkeypatch.setattr(_passages, "CROWD", hot)
    docs = fixture(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeated_bytes(frame(spark, docs), length=length, k=k).collect()}
    want = suffix_dedup.brute_force([(t or "").encode() for _, t in docs], length)
    assert got == {i: w for (i, _), w in zip(docs, want, strict=True)}


@pytest.mark.parametrize(("seed", "length", "k", "hot"), [(1, 12, 3, 1000), (2, 5, 2, 2), (3, 20, 5, 1)])
def test_earlier_words(spark, monkeypatch, seed, length, k, hot):
    monkeypatch.setattr(_passages, "CROWD", hot)
    docs = fixture(seed)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_earlier_words(frame(spark, docs), length=length, k=k).collect())
    assert got == substring_dedup.brute_force(docs, length)


def test_texts_longer_than_a_slice(spark):
    """Texts of over 256 KB that share a passage at their ends and in the middle, and repeat one of their own."""
    rng = random.Random(11)
    words = lambda n: [f"{rng.randrange(10**6)}é" for _ in range(n)]
    shared, own = words(40), words(30)
    texts = [words(20_000) + own + words(20_000) + own + shared, words(25_000) + shared + words(20_000), ["tail"] + shared[5:35]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert len(docs[0][1].encode()) > 1 << 18 and len(docs[1][1].encode()) > 1 << 18
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeated_bytes(frame(spark, docs), length=60, k=8).collect()}
    want = suffix_dedup.brute_force([t.encode() for _, t in docs], 60)
    assert got == dict(enumerate(want)) and [w[2] for w in want] == [2, 1, 1]
    earlier = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_earlier_words(frame(spark, docs), length=12, k=3).collect())
    assert earlier == substring_dedup.brute_force(docs, 12) and [r[2] for r in earlier] == [0, 40, 30]


def test_whole_query_on_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, suffix_dedup.brute_force([(r.text or "").encode() for r in rows], 400), strict=True)}


def test_passage_operators_take_empty_tables_and_rows_without_id(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert substring_dedup.remove_earlier_words(empty).count() == 0
    docs = spark.createDataFrame([(None, "w " * 80, 1, 1, ""), (5, "w " * 80, 1, 1, ""), (5, "w " * 80, 1, 1, "")], SCHEMA)
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs, length=20, k=4).collect()) == [160, 160, 160]
    assert [r.n_removed for r in substring_dedup.remove_earlier_words(docs, length=20, k=4).collect()] == [0, 0, 0]


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split(" ")


@pytest.mark.parametrize(("window", "block_words"), [(10, 2_000_000), (6, 60)])
def test_decontaminate_against_every_window(spark, window, block_words):
    rng = random.Random(window)
    word = lambda: rng.choice(["Alpha", "beta", "É1", "x9", "γ"])
    items = [(i, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.choice([1, 3, 6, 9, 10, 12, 30])))) for i in range(12)] + [(90, None), (91, "?!"), (None, "zz")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 40):
        docs.append((i, " ".join(rng.choice(items)[1] or "" if rng.random() < 0.3 else " ".join(f"u{rng.randint(0, 5)}" for _ in range(rng.randint(0, 20))) for _ in range(6))))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(frame(spark, docs), bench, window=window, k=3, block_words=block_words).collect()}
    wins = []
    for i, t in items:
        w = [x for x in words_of(t) if x]
        n = min(window, len(w))
        wins += [(str(i), tuple(w[a : a + n])) for a in range(len(w) - n + 1) if n and i is not None]
    for i, t in docs:
        w = [x for x in words_of(t) if x]
        hit, names = set(), set()
        for name, g in wins:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    names.add(name)
        assert got[i] == (len(w), len(hit), sorted(names))
    left = decontaminate.clean(frame(spark, [*docs, (0, None)]), bench, window=window, k=3, block_words=block_words)
    assert left.columns == ["doc_id", "text", "n", "start", "words"]
    assert sorted(r.doc_id for r in left.collect()) == sorted([0, *(i for i, _ in docs if not got[i][1])])


def test_decontaminate_long_texts_and_repeated_rows(spark):
    """A text of several slices that ends in an item, and rows that come twice; broadcast and joined."""
    item = " ".join(f"i{k}" for k in range(12))
    text = "filler words " * 60_000 + item
    bench = spark.createDataFrame([(1, item), (1, item), (2, "x " * 70)], "item_id long, text string")
    docs = frame(spark, [(1, text), (1, text), (2, None), (3, "clean")])
    for most in (1000, 10):
        got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, bench, block_words=most).collect())
        assert got == [(1, 120_012, 12, ["1"]), (1, 120_012, 12, ["1"]), (2, 0, 0, []), (3, 1, 0, [])]


@pytest.mark.parametrize("block_words", [2_000_000, 100])
def test_decontaminate_by_a_passage_that_all_items_share(spark, block_words):
    """300 items end alike; each list of items is that of a set of items, told once, however many windows have it."""
    shared = " ".join(f"s{k}" for k in range(30))
    items = [(i, f"{' '.join(f'i{i}x{k}' for k in range(10))} {shared}") for i in range(300)]
    docs = frame(spark, [(1, f"before {shared} after"), (2, items[7][1]), (3, " ".join(shared.split()[4:16])), (4, "i5x1 i5x2"), *((k, shared) for k in range(10, 60))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, bench, block_words=block_words).collect()}
    every = sorted(str(i) for i in range(300))
    assert got[1] == (30, every) and got[2] == (40, every) and got[4] == (0, [])
    assert got[3] == (12, every) and all(got[k] == (30, every) for k in range(10, 60))


def test_decontaminate_with_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")]), none).collect()[0].n_hit == 0
