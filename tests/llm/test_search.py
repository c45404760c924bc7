"""Search over the stratified index against scoring every document, and the cases that have to have a defined result."""

import random

import numpy as np
import pytest

from tracewright.llm import search

SCHEMA, ITEMS = "doc_id long, text string, m long, docs int, item string", "item_id long, text string, w int, term string"


def docs(seed: int) -> list[tuple[int | None, str | None]]:
    """Many lengths, many ties, a third of all rows of one length, nulls, texts without a term, and a long one."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cc", "Éa", "日本", "x9", "the", "the", "the"])
    texts = [rng.choice([" ", "-", "\x00"]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(word() for _ in range(12)) for _ in range(80)]
    texts += [None, "", " -- ", "rare", texts[3], texts[3], "the " * 20_000 + "b"]
    return [*enumerate(texts), (None, texts[5]), (5, texts[5])]


def queries(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(["a", "b", "CC", "Éa", "éa", "日本", "x9", "the", "none"]) for _ in range(rng.randint(1, 6)))) for k in range(12)] + [(20, None), (21, ""), (22, "missing"), (23, "RARE rare!"), (3, "x9")]


def table(spark, rows, schema):
    return spark.createDataFrame([(i, t, *([1, 2, "x"] if "item " in schema else [1, "x"])) for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"lead": 1, "block_docs": 4}), (3, {"query_terms": 5, "block_terms": 50}), (4, {"top": 3, "lead": 2})])
def test_search_equals_brute_force(spark, seed, options):
    got = search.search(table(spark, docs(seed), SCHEMA), table(spark, queries(seed), ITEMS), **options).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, search.brute_force(docs(seed), queries(seed), options.get("top", search.TOP))))


def test_index_holds_every_document_in_its_stratum(spark):
    blocks, n_docs = search.index(table(spark, docs(5), SCHEMA), block_docs=8)
    rows = blocks.collect()
    with_terms = [(i, t) for i, t in docs(5) if search.terms_of((t or "").encode())]
    assert n_docs == len(with_terms) and sorted(d for r in rows for d in r.docs) == sorted(search.LAST if i is None else i for i, _ in with_terms)
    total = sum(len(search.terms_of(t.encode())) for _, t in with_terms)
    length = {i: len(search.terms_of(t.encode())) for i, t in with_terms if i is not None}
    for r in rows:
        assert len(r.docs) <= 16 and all(r.m == 10 + 90 * length[d] * n_docs // total for d in r.docs if d < search.LAST)
        assert r.ends[-1] == len(r.postings) and len(r.terms) == len(r.peaks) == len(r.dfs) == len(r.groups) and r.groups[-1] == len(r.tfs)
        assert sum(r.dfs) == len(r.postings) and list(r.terms) == sorted(r.terms)


def test_bounds_hold(spark):
    blocks, n_docs = search.index(table(spark, docs(6), SCHEMA), block_docs=8)
    rows = search.weighted(search.queries_of(table(spark, queries(6), ITEMS)), blocks, n_docs).collect()
    q = search.Queries(rows)
    bound = {(r["item"], r["m"]): r["bound"] for r in search.stratum_bounds(blocks, q).collect()}
    stratum = {d: b.m for b in blocks.collect() for d in b.docs}
    found = search.visited(blocks, q, np.zeros(len(q.ids), np.int64), None, None, 1000).collect()
    assert found and all(r.score <= bound[r["item"], stratum[r.doc_id]] for r in found)


def test_empty_tables(spark):
    none, some = table(spark, [], SCHEMA), table(spark, docs(7), SCHEMA)
    assert search.search(none, table(spark, queries(7), ITEMS)).collect() == []
    assert search.search(some, table(spark, [], ITEMS)).collect() == []
    assert search.search(table(spark, [(1, None), (2, "")], SCHEMA), table(spark, queries(7), ITEMS)).collect() == []
