"""Passages that may occur twice, found by what they contain.

A sequence is the bytes or the words of a text. Each window of ``length`` units is named after its anchor, the k-gram
of smallest hash in it, the first of equal ones. Equal windows have equal anchors, so all that can be equal meets
under one anchor, and no window belongs to two. Consecutive windows with one anchor form a stretch. Identical
stretches are counted once (by anchor and a hash of the whole content); the others under an anchor go to one shard,
which compares them exactly. Where an anchor has more of them than a shard should hold, their windows are named again
after longer k-grams, up to the window itself, and what then meets goes to shards in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows, stored

#: Stretches of one anchor that a shard takes; beyond, windows are named again.
CROWD = 1000
SPACES = A.word_table(lower_ascii_words=False)


def grams(length: int, k: int) -> list[int]:
    """Lengths of the k-grams that name windows, at first and where an anchor is crowded."""
    return [k, *sorted({length - (length - k) // 5, length} - {k})]


def units(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values to hash, first unit of each row, bytes, and start and end of each unit (words only).

    A binary column holds such values already.
    """
    if pa.types.is_binary(column.type):
        data, offsets = A.text_bytes(column)
        values = np.frombuffer(data.tobytes(), np.uint64 if words else np.uint8)
        return values, offsets // values.itemsize, data, offsets, offsets
    data, offsets = A.text_bytes(column)
    if not words:
        return data, offsets, data, offsets, offsets
    starts, ends, first = A.word_bounds(data, offsets, SPACES)
    return A.word_hashes(data, starts, ends), first, data, starts, ends


def runs(values: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first window (from the row's start), number of windows, anchor and content hash of each stretch."""
    n = len(values) - length + 1
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n <= 0:
        return empty
    prefix = A.Prefix(values, A.BASE_WORDS)
    hashes = prefix.all(k)
    chosen = A.sliding_first_min(hashes, length - k + 1)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.arange(length, n + length) <= np.repeat(first[1:], sizes)[:n]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
    at = np.flatnonzero(begins)
    if not len(at):
        return empty
    count = np.add.reduceat(valid.astype(np.int64), at)
    raw, size = memoryview(values.tobytes()), values.itemsize
    ends = (at + count + length - 1) * size
    body = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((at * size).tolist(), ends.tolist(), strict=True)), np.uint64, len(at))
    return row[at], at - first[row[at]], count, hashes[chosen[at]], body


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and the hash that tells apart rows of one id."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h"))


def stretches(docs: DataFrame, *, words: bool, length: int, k: int) -> DataFrame:
    """doc_id, h, start, n (windows), anchor and body (hash of the content) of each stretch."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            values, first, *_ = units(batch.column(1), words)
            row, start, count, anchor, body = runs(values, first, length, k)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64))],
                names=["doc_id", "h", "start", "n", "anchor", "body"],
            )

    return stored(docs.select("doc_id", "text", "h").mapInArrow(run, f"doc_id {kind}, h long, start int, n int, anchor long, body long"))


def candidates(found: DataFrame, *, other_ids: bool) -> DataFrame:
    """The stretches whose anchor has another stretch, or one of another id.

    Counts are summed up before rows are dealt and written before they are joined, so that Spark can split the
    stretches of an anchor that a large part of all documents has.
    """
    if other_ids:
        anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    else:
        anchors = found.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1")
    return stored(found.join(stored(anchors.select("anchor")), "anchor", "left_semi"))


def contents(source: DataFrame, wanted: DataFrame, *, words: bool, length: int) -> DataFrame:
    """anchor, body, extra, hot and content (bytes, or the words' hashes) of stretches of the rows of source.

    wanted: doc_id, h, start, n, anchor, body, extra, hot.
    """
    grouped = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "anchor", "body", "extra", "hot")).alias("cuts"))
    joined = _with(source, grouped, "inner").select("text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            values, first, *_ = units(batch.column(0), words)
            cuts = batch.column(1)
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(cuts.offsets.to_numpy()))
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            a = first[row] + start
            b = a + n + length - 1
            raw = values.tobytes()
            size = values.itemsize
            content = pa.array([raw[x * size : y * size] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("anchor", "body", "extra", "hot")), content], names=["anchor", "body", "extra", "hot", "content"])

    return joined.mapInArrow(run, "anchor long, body long, extra long, hot boolean, content binary")


def _with(docs: DataFrame, grouped: DataFrame, how: str) -> DataFrame:
    """Documents with what is known of them; rows without id keep theirs."""
    g = grouped.hint("shuffle_hash")
    return docs.join(g, docs["doc_id"].eqNullSafe(g["doc_id"]) & (docs["h"] == g["h"]), how)


Shard = Callable[[pa.Table], tuple]


def marked(source: DataFrame, found: DataFrame, extra: Column, shard: Shard, *, words: bool, length: int, ks: list[int], most: int) -> DataFrame:
    """anchor, body, a, m, extra: ranges of windows of a stretch that occur elsewhere, extra being the least of their bearers'.

    source: doc_id, h and text (or content) that the stretches found lie in; ks: grams of their anchors and of those that
    crowded ones get instead. shard: (row, a, m, extra) arrays of ranges of windows of rows of a table of whole anchors.
    """
    one = F.min(F.struct("doc_id", "h", "start", "n")).alias("one")
    bodies = stored(found.groupBy("anchor", "body").agg(one, F.count("*").alias("copies"), F.min(extra).cast("long").alias("extra")))
    copied = bodies.where("copies > 1").select("anchor", "body", F.lit(0).alias("a"), F.col("one.n").alias("m"), "extra")
    if len(ks) == 1:
        return copied
    crowds = stored(bodies.groupBy("anchor").agg(F.count("*").alias("bodies")).where("bodies > 1"))
    wanted = bodies.join(crowds, "anchor").select("one.*", "anchor", "body", "extra", (F.col("bodies") > CROWD).alias("hot"))
    dealt = contents(source, wanted, words=words, length=length).repartition(F.col("anchor"), F.when(F.col("hot"), F.col("body")).otherwise(F.lit(0))).sortWithinPartitions("anchor")
    out = stored(dealt.mapInArrow(_compared(shard, words, length, ks[1], most), "anchor long, body long, a int, m int, extra long, next long, content_hash long, content binary"))
    plain = out.where("next is null and content is null").select("anchor", "body", "a", "m", "extra")
    marks = copied.unionByName(plain)
    if not crowds.where(F.col("bodies") > CROWD).limit(1).count():
        return marks
    held = out.where("content is not null").select(F.col("anchor").alias("doc_id"), F.col("body").alias("h"), F.col("content").alias("text"))
    parts = out.where("next is not null").select(F.col("anchor").alias("doc_id"), F.col("body").alias("h"), F.col("a").alias("start"), F.col("m").alias("n"), F.col("next").alias("anchor"), F.col("content_hash").alias("body"), "extra")
    finer = marked(held, parts, F.col("extra"), shard, words=words, length=length, ks=ks[1:], most=most)
    up = parts.drop("extra").join(finer, ["anchor", "body"]).select(F.col("doc_id").alias("anchor"), F.col("h").alias("body"), (F.col("start") + F.col("a")).alias("a"), "m", "extra")
    return marks.unionByName(up)


def _compared(shard: Shard, words: bool, length: int, k: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Content in; out come the ranges that shards found and, of crowded anchors, the content and its stretches by longer grams."""
    names = ["anchor", "body", "a", "m", "extra", "next", "content_hash", "content"]

    def rows(table, row, a, m, extra, anchor, body, content) -> pa.RecordBatch:
        take = pa.array(row)
        own = [table.column(c).take(take) for c in ("anchor", "body")]
        own = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in own]
        return pa.RecordBatch.from_arrays([*own, pa.array(a, pa.int32()), pa.array(m, pa.int32()), pa.array(extra, pa.int64()), anchor, body, content], names=names)

    def crowded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        none, every = pa.nulls(batch.num_rows, pa.int64()), np.arange(batch.num_rows)
        yield rows(batch, every, every * 0, every * 0, batch.column("extra"), none, none, batch.column("content"))
        for part in A.slices(iter([batch]), "content"):
            values, first, *_ = units(part.column("content"), words)
            row, a, m, anchor, body = runs(values, first, length, k)
            yield rows(part, row, a, m, part.column("extra").take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), pa.nulls(len(row), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pa.RecordBatch] = []

        def uncrowded() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hot = batch.column("hot")
                aside.append(batch.filter(hot))
                yield batch.filter(pc.invert(hot))

        for table in by_anchor(uncrowded(), most):
            row, a, m, extra = shard(table)
            none = pa.nulls(len(row), pa.int64())
            yield rows(table, row, a, m, extra, none, none, pa.nulls(len(row), pa.binary()))
            while aside:
                yield from crowded(aside.pop())
        while aside:
            yield from crowded(aside.pop())

    return run


def by_anchor(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor, in tables of whole anchors of about that many bytes of content."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table.column("anchor").to_numpy()
        last = int(np.searchsorted(anchors, anchors[-1]))
        if last:
            yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)
    return edge[:, 0], edge[:, 1] - edge[:, 0]


def removed(docs: DataFrame, found: DataFrame, digest: Callable[..., tuple], *, words: bool, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Per document what ``digest(data, starts, ends, gone)`` says of its units: where they lie and which are to go.

    found: doc_id, h, start, n of ranges of units to remove; they may overlap.
    """
    arrow_rows(docs.sparkSession)
    grouped = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    joined = _with(docs, grouped, "left").select(docs["doc_id"], "text", "cuts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            _, first, data, starts, ends = units(batch.column(1), words)
            cuts = batch.column(2)
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(cuts), 0).to_numpy())
            a, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            gone = A.covered(first[row] + a, n.astype(np.int64), int(first[-1]))
            out = []
            for u, v in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                out.append(digest(data, starts[u:v], ends[u:v], gone[u:v]) if words else digest(data[u:v], None, None, gone[u:v]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, {schema}")
