"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams of words the one of smallest hash is a fingerprint, so each stretch
of ``window`` words that a document shares with a benchmark item has a fingerprint in common with it. Every hit is
extended to all windows about it, which are compared by a hash of 128 bits. Items of fewer words than a window lie below
what winnowing guarantees and are looked up whole.

The benchmark is hashed once, in pieces of bounded length, and its words are counted. Up to ``block_words`` of them, its
tables are broadcast and the fingerprints are joined in the tasks that read the documents; beyond, the fingerprints of
both sides are joined by Spark, and so are the windows about the hits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows, stored

WINDOW, K, BLOCK_WORDS, PIECE = 10, 5, 2_000_000, 50_000


def item_words(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item (string), n words of the item, and the hashes of the words of a piece; pieces overlap by a window less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lower = A.word_table(lower_ascii_words=True), A.lower_table()
        for batch in A.slices(batches, "text"):
            data, offsets = A.text_bytes(batch.column(1))
            data = lower[data]
            starts, ends, first = A.word_bounds(data, offsets, table)
            one, two = A.word_hashes(data, starts, ends), A.word_hashes(data, starts, ends, A.BASE_CHECK)
            rows = []
            for k, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                for p in range(a, max(a + 1, b - window + 1), PIECE) if b > a else ():
                    q = min(b, p + PIECE + window - 1)
                    rows.append((item, b - a, q - p, one[p:q].tobytes(), two[p:q].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["item", "n", "words", "one", "two"])

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).where("item is not null").distinct()
    return stored(rows.mapInArrow(run, "item string, n long, words long, one binary, two binary"))


def block_tables(rows: list, window: int, k: int) -> dict:
    """Sorted window hashes with their items, and the fingerprints; by length for items shorter than a window."""
    names = sorted({r["item"] for r in rows})
    index = {x: i for i, x in enumerate(names)}
    by_length: dict[int, list] = {}
    prints = []
    for r in rows:
        one, two = np.frombuffer(r["one"], np.uint64), np.frombuffer(r["two"], np.uint64)
        n = min(window, r["n"])
        h, g = A.Prefix(one, A.BASE_WORDS).all(n), A.Prefix(two, A.BASE_CHECK).all(n)
        by_length.setdefault(n, []).append((h, g, np.full(len(h), index[r["item"]])))
        if n == window:
            grams = A.Prefix(one, A.BASE_WORDS).all(k)
            prints.append(grams[np.unique(A.sliding_first_min(grams, window - k + 1))])
    lengths = {}
    for n, parts in by_length.items():
        h, g, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((item, g, h))
        h, g, item = h[order], g[order], item[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        lengths[n] = h[fresh], g[fresh], np.append(np.flatnonzero(fresh), len(h)), item
    return {"names": names, "lengths": lengths, "prints": np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)}


def _sieve(ordered: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(ordered >> np.uint64(44)).astype(np.int64)] = True
    return seen


def hits(block: dict, one: np.ndarray, second: Callable[[], A.Prefix], first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Starts and lengths of the windows hit, over the words of a slice, and the pairs of row and item."""
    n, row = len(one), np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row] if n else np.zeros(0, np.int64)
    prefix = A.Prefix(one, A.BASE_WORDS)
    at, size, pairs = [], [], set()
    for length, (h, g, bounds, item) in block["lengths"].items():
        if n < length:
            continue
        if length == window:
            grams = prefix.all(k)
            chosen = np.unique(A.sliding_first_min(grams, window - k + 1))
            chosen = chosen[block["sieve"][(grams[chosen] >> np.uint64(44)).astype(np.int64)]]
            chosen = chosen[A.member(grams[chosen], block["prints"]) >= 0]
            begin = np.unique((chosen[:, None] - np.arange(window - k + 1)).ravel())
            begin = begin[(begin >= 0) & (begin + length <= n)]
        else:
            begin = np.arange(n - length + 1)
        begin = begin[begin + length <= end[begin]]
        mine = prefix.hashes(begin, begin + length)
        lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
        begin, lo, hi = (x[hi > lo] for x in (begin, lo, hi))
        if not len(begin):
            continue
        sure = second().hashes(begin, begin + length)
        spot, owner = A.spread(lo, hi - lo), np.repeat(np.arange(len(begin)), hi - lo)
        same = g[spot] == sure[owner]
        spot, owner = spot[same], owner[same]
        at.append(begin[owner])
        size.append(np.full(len(owner), length))
        found = np.unique(np.stack([row[begin[owner]], spot]), axis=1)
        many = bounds[found[1] + 1] - bounds[found[1]]
        both = np.unique(np.stack([np.repeat(found[0], many), item[A.spread(bounds[found[1]], many)]]), axis=1)
        pairs |= {(int(r), block["names"][int(i)]) for r, i in both.T}
    empty = np.zeros(0, np.int64)
    return np.concatenate(at) if at else empty, np.concatenate(size) if size else empty, sorted(pairs)


def searched(column: pa.Array, tables: dict, window: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """First word of each row, which words are hit, and the pairs of row and item, of a slice."""
    one, first, second = hashed(column)
    if "sieve" not in tables:
        tables["sieve"] = _sieve(tables["prints"])
    at, size, pairs = hits(tables, one, second, first, window, k)
    return first, A.covered(at, size, len(one)), pairs


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[], A.Prefix]]:
    """Hashes of all words, the first word of each row, and sums of their second hashes when asked for."""
    data, offsets = A.text_bytes(column)
    data = A.lower_table()[data]
    starts, ends, first = A.word_bounds(data, offsets, A.word_table(lower_ascii_words=True))
    return A.word_hashes(data, starts, ends), first, functools.cache(lambda: A.Prefix(A.word_hashes(data, starts, ends, A.BASE_CHECK), A.BASE_CHECK))


def item_windows(pieces: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Windows: n (words, 0 for a fingerprint), w and x (the window's hash), e and f (of the set of items that have it).
    Sets: e, f, item. Neither holds a list, so that a window that all items share is a row like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, one, two in zip(*(batch.column(c).to_pylist() for c in ("item", "n", "one", "two")), strict=True):
                one, size = A.Prefix(np.frombuffer(one, np.uint64), A.BASE_WORDS), min(window, n)
                w, x = one.all(size), A.Prefix(np.frombuffer(two, np.uint64), A.BASE_CHECK).all(size)
                sizes = np.full(len(w), size)
                if n >= window:
                    grams = one.all(k)
                    prints = np.unique(grams[A.sliding_first_min(grams, window - k + 1)])
                    w, x, sizes = np.append(w, prints), np.append(x, np.zeros(len(prints), np.uint64)), np.append(sizes, np.zeros(len(prints), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32)), pa.array(w.view(np.int64)), pa.array(x.view(np.int64)), pa.array([item if s else None for s in sizes.tolist()], pa.string())], names=["n", "w", "x", "item"])

    rows = pieces.mapInArrow(run, "n int, w long, x long, item string")
    each = stored(rows.distinct())
    windows = stored(each.groupBy("n", "w", "x").agg(F.bit_xor(F.xxhash64("item")).alias("e"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("f")))
    one = windows.where("n > 0").groupBy("e", "f").agg(F.min(F.struct("n", "w", "x")).alias("r")).select("e", "f", "r.*")
    return windows, stored(one.join(each, ["n", "w", "x"]).select("e", "f", "item"))


def text_key(text: Column) -> list[Column]:
    """Two hashes of a text: rows of one text are searched once."""
    return [F.xxhash64(text).alias("c"), F.hash(text).alias("d")]


def joined(docs: DataFrame, text: str, pieces: DataFrame, window: int, k: int) -> DataFrame:
    """c, d, items and cuts (start, n) of the texts hit, for a benchmark of any size: joins on fingerprints, then on windows."""
    arrow_rows(docs.sparkSession)
    known, sets = item_windows(pieces, window, k)
    t = F.col(f"`{text}`")
    texts = docs.where(t.isNotNull()).select(*text_key(t), t.alias("text"))
    shorter = sorted(r["n"] for r in known.where(F.col("n").between(1, window - 1)).select("n").distinct().collect())
    places = {r["p"] for r in known.where(F.col("n").between(1, window - 1)).select(F.shiftrightunsigned("w", 44).alias("p")).distinct().collect()}
    sieve = np.zeros(1 << 20, bool)
    sieve[list(places)] = True
    kinds = "c long, d int, start int, count int, n int, w long, x long"

    def rows(batch: pa.RecordBatch, row, start, count, n, w, x) -> pa.RecordBatch:
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(np.full(len(row), n), pa.int32()), pa.array(w.view(np.int64)), pa.array(x.view(np.int64))], names=["c", "d", "start", "count", "n", "w", "x"])

    def whole(first: np.ndarray, length: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins of windows that lie within a row, and those rows."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.arange(max(0, total - length + 1))
        at = at[at + length <= first[1:][row[at]]]
        return at, row[at]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each fingerprint, with the windows that have it; and all windows of a short item's length that the sieve lets pass."""
        for batch in A.slices(batches, "text"):
            one, first, second = hashed(batch.column(2))
            prefix = A.Prefix(one, A.BASE_WORDS)
            at, row = whole(first, window, len(one))
            if len(at):
                grams = prefix.all(k)
                chosen = A.sliding_first_min(grams, window - k + 1)[at]
                begins = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
                count = np.diff(np.append(begins, len(at)))
                start = at[begins] - first[row[begins]]
                yield rows(batch, row[begins], start, count, 0, grams[chosen[begins]], np.zeros(len(begins), np.uint64))
            for n in shorter:
                at, row = whole(first, n, len(one))
                w = prefix.hashes(at, at + n)
                some = sieve[(w >> np.uint64(44)).astype(np.int64)]
                at, row, w = at[some], row[some], w[some]
                if len(at):
                    yield rows(batch, row, at - first[row], np.ones(len(at), np.int64), n, w, second().hashes(at, at + n))

    found = texts.mapInArrow(printed, kinds)
    short = found.where("n > 0")
    near = found.where("n = 0").join(known.where("n = 0").select("w"), "w", "left_semi").groupBy("c", "d").agg(F.collect_set(F.struct("start", "count")).alias("cuts")).hint("shuffle_hash")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows about the hits."""
        for batch in A.slices(batches, "text"):
            one, first, second = hashed(batch.column(2))
            cuts = batch.column(3)
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(cuts.offsets.to_numpy()))
            start, count = flat.field("start").to_numpy(), flat.field("count").to_numpy()
            at, row = A.spread(first[row] + start, count.astype(np.int64)), np.repeat(row, count)
            yield rows(batch, row, at - first[row], np.ones(len(at), np.int64), window, A.Prefix(one, A.BASE_WORDS).hashes(at, at + window), second().hashes(at, at + window))

    long = texts.dropDuplicates(["c", "d"]).join(near, ["c", "d"]).select("c", "d", "text", "cuts").mapInArrow(extended, kinds)
    hit = stored(long.unionByName(short).join(known.where("n > 0"), ["n", "w", "x"]).select("c", "d", "start", "n", "e", "f"))
    cuts = hit.groupBy("c", "d").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    named = hit.select("c", "d", "e", "f").distinct().join(sets, ["e", "f"])
    return cuts.join(named.groupBy("c", "d").agg(F.array_sort(F.collect_set("item")).alias("items")), ["c", "d"])


def _benchmark(items: DataFrame, item_id: str, item_text: str, window: int, k: int, block_words: int) -> tuple[DataFrame, dict | None]:
    """The pieces of the benchmark and, where they have no more than block_words words, their tables."""
    pieces = item_words(items, item_id, item_text, window)
    total = pieces.agg(F.sum("words")).first()[0] or 0
    return pieces, block_tables(pieces.collect(), window, k) if total <= block_words else None


def _answer(batch: pa.RecordBatch, first: np.ndarray, hit: np.ndarray, items: list) -> pa.RecordBatch:
    n_hit, spans = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
    if hit.any():
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        np.add.at(n_hit, row[hit], 1)
        for r in np.flatnonzero(n_hit).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[r] : first[r + 1]].view(np.int8), [0]])))
            spans[r] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (array, sorted as strings), spans (array of word ranges hit, end exclusive).

    A null or empty text has no words and no hit. Repeated rows are answered each. Items without words or id match
    nothing; an empty benchmark leaves all documents clean. Other columns of either table are not read.
    """
    arrow_rows(docs.sparkSession)
    pieces, tables = _benchmark(items, item_id, item_text, window, k, block_words)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    if tables is None:
        found = joined(docs, text, pieces, window, k)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in A.slices(batches, "text"):
                one, first, _ = hashed(batch.column(1))
                cuts = batch.column(2)
                flat = cuts.flatten()
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(cuts), 0).to_numpy())
                hit = A.covered(first[row] + flat.field("start").to_numpy(), flat.field("n").to_numpy().astype(np.int64), len(one))
                yield _answer(batch, first, hit, [x or [] for x in batch.column(3).to_pylist()])

        keyed = narrow.select("doc_id", "text", *text_key(F.col("text")))
        return keyed.join(found, ["c", "d"], "left").select("doc_id", "text", "cuts", "items").mapInArrow(told, kinds)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            first, hit, pairs = searched(batch.column(1), shared.value, window, k)
            names: dict[int, set] = {}
            for r, name in pairs:
                names.setdefault(r, set()).add(name)
            yield _answer(batch, first, hit, [sorted(names.get(r, ())) for r in range(batch.num_rows)])

    return narrow.mapInArrow(run, kinds)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, all columns, none of whose words is hit."""
    arrow_rows(docs.sparkSession)
    pieces, tables = _benchmark(items, item_id, item_text, window, k, block_words)
    if tables is None:
        t, found = F.col(f"d.`{text}`"), joined(docs, text, pieces, window, k).select("c", "d").alias("f")
        return docs.alias("d").join(found, (F.xxhash64(t) == F.col("f.c")) & (F.hash(t) == F.col("f.d")), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, text):
            first, hit, _ = searched(batch.column(batch.schema.get_field_index(text)), shared.value, window, k)
            total = np.append(0, np.cumsum(hit))
            yield batch.filter(pa.array(total[first[1:]] == total[first[:-1]]))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Digest of ``decontaminate`` over the whole of documents against the whole of benchmark."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB, by all windows instead of fingerprints.
ORACLE_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, win.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, lens WHERE len(w) >= n)) d JOIN win ON win.g = d.g AND win.n = d.n),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') ids FROM occ GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op3_decontaminate": (op3_decontaminate, ORACLE_SQL)}
