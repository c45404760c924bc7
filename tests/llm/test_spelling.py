"""Composed machines against a comparison of every two words, and the cases that have to have a defined result."""

import random

import pytest

from tracewright.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string"


def vocabulary(seed: int, n: int, letters: str = "abé") -> list[str]:
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)})


def near(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def expected(words: list[str]) -> set[frozenset]:
    return {frozenset((x, y)) for k, x in enumerate(words) for y in words[k + 1 :] if near(x, y)}


def accepted(final, arcs, words):
    for w in words:
        state = len(final) - 1
        for c in w:
            state = arcs[state].get(c)
            if state is None:
                return False
        if not final[state]:
            return False
    return True


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptor_is_minimal_and_one_edit_is_all_pairs(seed):
    words = vocabulary(seed, 250)
    final, arcs = spelling.acceptor(words)
    assert accepted(final, arcs, words) and not accepted(final, arcs, ["abababababab"])
    assert len({(f, tuple(a.items())) for f, a in zip(final, arcs, strict=True)}) == len(final)
    pairs = spelling.one_edit(words)
    assert len(pairs) == len(set(map(frozenset, pairs))) and {frozenset((words[x], words[y])) for x, y in pairs} == expected(words)


def test_one_edit_of_few_and_of_very_long_words():
    assert spelling.one_edit([]) == [] and spelling.one_edit([""]) == [] and spelling.one_edit(["", "a"]) == [(1, 0)]
    long = "ab" * 20_000
    assert sorted(map(sorted, spelling.one_edit(sorted([long, long + "c", long[:-1] + "x"])))) == [[0, 1], [0, 2]]


@pytest.mark.parametrize(("depth", "most"), [(None, 20_000), (None, 9), (1, 1), (4, 1), (12, 1)])
def test_pairs_do_not_depend_on_partitions(spark, depth, most):
    words = vocabulary(7, 300)
    table = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = spelling.near_pairs(table, most=most, depth=depth).collect()
    assert {frozenset((r.a, r.b)) for r in got} == expected(words) and len(got) == len(expected(words))
    assert all(words[r.a_n] == r.a and words[r.b_n] == r.b for r in got)
    if depth is None and most == 9:
        d = spelling.depth_of(table, most)
        assert d > 1 and max(sum(w[:d] == p for w in words) for p in {w[:d] for w in words}) <= most


def docs(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [w + "ing" for w in vocabulary(seed, 40, "aBÀ×")]
    rows = [(k, " ".join(rng.choice(base) + rng.choice(["", "", "s", "!", "日"]) for _ in range(60))) for k in range(40)]
    return [*rows, (None, None), (41, None), (42, ""), (None, rows[0][1]), (0, rows[0][1]), (43, "Z" * 5000 + " " + "word " * 9000), (44, "chain " * 20 + "chaina " * 8 + "chainab " * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs(seed)], SCHEMA).repartition(4)
    got = spelling.variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, spelling.brute_force(docs(seed))))
    assert any(r.form and r.root != r.form for r in got)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "a b c", "x", 1, "y")], SCHEMA)).collect() == []


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("z", None)], "word string, form string")
    assert {r.word: r.root for r in spelling.rooted(forms).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "z": "z"}
