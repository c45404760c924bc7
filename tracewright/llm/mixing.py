"""Mixing sources to target weights by drawing fixed-length blocks.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of one length: ``block_words``
words at most, shorter where a source would have fewer than ``LEAST_BLOCKS``, and such that the last is about full. The
targets fix how many block slots each source has in all; output shards draw multinomial counts from what is left of
these totals, so the last shard closes the sum. A source's slots are numbered across the shards, a keyed permutation
of its block numbers (a new one each time round) turns slots into blocks, and the blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._session import cut

WEIGHTS, SHARE, MOST, BLOCK_WORDS, LEAST_BLOCKS, SHARD_SLOTS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 64, 128, 1 << 14, 20_240
#: Sources dealt together, and counts of groups of shards by bundle that the driver draws.
BUNDLE, MOST_COUNTS = 1024, 200_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source; sources by code point, null last, get the weights in turn."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    rest, free = share * sum(sizes.values()), list(names)
    while free:
        each = rest / sum(weight[s] for s in free)
        above = [s for s in free if each * weight[s] > most * sizes[s]]
        for s in above or free:
            out[s] = most * sizes[s] if above else each * weight[s]
        if not above:
            break
        rest -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def even(total: int, parts: int) -> Iterator[int]:
    """A total in parts at most one apart."""
    for k in range(parts):
        n = total // (parts - k)
        total -= n
        yield n


def split(totals: np.ndarray, sizes: Iterable[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Deals totals to parts of these sizes: multinomial counts from what is left, which the last part closes."""
    left = totals.astype(np.int64)
    for n in sizes:
        draw = np.zeros_like(left)
        while (short := int(n) - int(draw.sum())) > 0:
            room = left - draw
            draw += np.minimum(rng.multinomial(short, room / room.sum()), room)
        left = left - draw
        yield draw


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)


def permuted(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """Of each index its image in the permutation of range(n) that key names: a Feistel network, walked until it falls inside."""
    n, key = (np.broadcast_to(np.asarray(x), index.shape).astype(np.uint64) for x in (n, key))
    # halves of so many bits hold n - 1; counts are below 2^52, exact as doubles
    half = np.maximum(1, (np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1] + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = [mixed(key ^ mixed(np.array([r + 1], np.uint64))) for r in range(4)]
    out, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half[todo], out[todo] & low[todo]
            for k in keys:
                left, right = right, left ^ (mixed(right + k[todo]) & low[todo])
            out[todo] = left << half[todo] | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def packed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size and at (where the document begins among its source's words).

    The order of a source is that of a hash of the id. Offsets are summed within buckets of ids and then over buckets, so
    that no task holds a source.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("mix", F.xxhash64("doc_id")).withColumn("bucket", F.shiftrightunsigned("mix", 52))
    each = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offset = each.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    here = rows.withColumn("local", local).alias("d")
    joined = here.join(offset.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    return joined.select("d.doc_id", "d.source", "d.size", (F.col("before") + F.col("local")).alias("at"))


def slots(spark, want: np.ndarray, blocks: np.ndarray, *, shard_slots: int, seed: int, bundle: int = BUNDLE) -> DataFrame:
    """shard, source (its number), slot and block of all draws.

    Sources are dealt in bundles: bundles to groups of shards on the driver, a bundle's sources to the groups in a task of
    its own, and the shards of a group by bundle. Each count is multinomial, of bundles first and of sources inside them.
    """
    shards = max(1, -(-int(want.sum()) // shard_slots))
    bundles = np.add.reduceat(want, np.arange(0, len(want), bundle)) if len(want) else np.zeros(1, np.int64)
    groups = int(min(shards, max(1, MOST_COUNTS // len(bundles))))
    per = -(-shards // groups)
    dealt = np.array(list(split(bundles, even(int(bundles.sum()), groups), np.random.default_rng([seed, 0]))))
    rows = [(b, want[b * bundle : (b + 1) * bundle].tolist(), blocks[b * bundle : (b + 1) * bundle].tolist(), dealt[:, b].tolist()) for b in range(len(bundles))]

    def by_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, mine, sizes, parts in frame.itertuples(index=False):
                at = np.zeros(len(mine), np.int64)
                for g, draw in enumerate(split(np.array(mine, np.int64), parts, np.random.default_rng([seed, 1, b]))):
                    if draw.any():
                        yield pd.DataFrame({"b": [b], "g": [g], "start": [at], "draw": [draw], "sizes": [np.array(sizes, np.int64)]})
                    at = at + draw

    def by_shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, g, at, draw, sizes in frame.itertuples(index=False):
                at, draw, sizes = (np.array(x, np.int64) for x in (at, draw, sizes))
                mine = (part[b] for part in split(dealt[g], even(int(dealt[g].sum()), per), np.random.default_rng([seed, 2, g])))
                for k, part in enumerate(split(draw, mine, np.random.default_rng([seed, 3, b, g]))):
                    s = np.repeat(np.arange(len(part)), part)
                    slot = at[s] + np.arange(len(s)) - (np.cumsum(part) - part)[s]
                    turn, source = slot // sizes[s], s + b * bundle
                    key = mixed(mixed(source.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) + turn.astype(np.uint64))
                    yield pd.DataFrame({"shard": g * per + k, "source": source, "slot": slot, "block": permuted(slot % sizes[s], sizes[s], key)})
                    at = at + part

    table = spark.createDataFrame(rows, "b long, want array<long>, sizes array<long>, parts array<long>").repartition(min(len(rows), 512), "b")
    told = table.mapInPandas(by_group, "b long, g long, start array<long>, draw array<long>, sizes array<long>")
    return told.repartition(int(min(groups * len(rows), 512)), "b", "g").mapInPandas(by_shard, "shard long, source int, slot long, block long")


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, bundle: int = BUNDLE) -> tuple[DataFrame, DataFrame, dict, dict]:
    """Documents in place, the draws, and the sizes and targets by source (one entry each)."""
    spark = docs.sparkSession
    placed = cut(packed(docs, doc_id, text, source))
    sizes = {r["source"]: int(r["n"]) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    want = targets(sizes, weights, share, most)
    names = [s for s in want if sizes[s]]
    length = [max(1, min(block_words, sizes[s] // LEAST_BLOCKS)) for s in names]
    length = [-(-sizes[s] // -(-sizes[s] // n)) for s, n in zip(names, length, strict=True)]
    blocks = np.array([-(-sizes[s] // n) for s, n in zip(names, length, strict=True)], np.int64)
    count = np.array([min(int(most * b), round(want[s] / sizes[s] * b)) for s, b in zip(names, blocks, strict=True)], np.int64)
    drawn = slots(spark, count, blocks, shard_slots=shard_slots, seed=seed, bundle=bundle)
    known = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate(zip(names, length, strict=True))], "s string, k int, length long")
    return placed.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), drawn, sizes, want


def pieces(placed: DataFrame) -> DataFrame:
    """doc_id, size, at, k, block, first (word of the document) and n (words of it in the block)."""
    last = F.floor((F.col("at") + F.col("size") - 1) / F.col("length"))
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.col("length")), last)))
    low, high = F.greatest("at", F.col("block") * F.col("length")), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return rows.select("doc_id", "size", "at", "k", "block", (low - F.col("at")).alias("first"), (high - low).alias("n"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot, doc_id, first and n, the words [first, first + n) of a document that a slot takes.

    A null text or source is allowed: no words, and a source of its own. Other columns are not read.
    """
    placed, drawn, _, _ = plan(docs, **options)
    return drawn.withColumnRenamed("source", "k").join(pieces(placed), ["k", "block"]).select("shard", "slot", "doc_id", "first", "n")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words the mix takes of it, repeats counted).

    Each row is packed, repeated ones too; among rows that agree in all, which of them is taken is open. Empty
    documents and sources of no words are never taken. An empty table gives an empty mix. Runs of one table agree.
    """
    placed, drawn, sizes, want = plan(docs, **options)
    draws = drawn.groupBy(F.col("source").alias("k"), "block").agg(F.count("*").alias("times"))
    # dense numbers compress so well that a shuffle of all draws looks small enough to broadcast, which it is not
    taken = pieces(placed).join(draws.hint("merge"), ["k", "block"]).groupBy("k", "at").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    full = placed.where("size > 0").join(taken, ["k", "at"], "left").select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    every = full.unionByName(placed.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    known = docs.sparkSession.createDataFrame([(s, sizes[s], float(want[s])) for s in want], "s string, source_size long, target double")
    return every.join(known, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """``mix`` over the whole of documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_mix": (op5_mix, None)}
