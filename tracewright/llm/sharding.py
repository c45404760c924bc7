"""Dealing documents to shards of near equal bytes by histogram sort.

Rows are ordered by two keys of 60 bits, one of the text and one of the id, so equal texts are neighbours and no two
different rows tie. The splitters between shards are found by counting: each turn lays evenly spaced probes over the
stretches of keys that still hold a splitter, all partitions count the exact bytes between probes, and only the stretch
around each target stays open, until it holds a single key. First the probes go over texts. Where an edge between two
texts lies within ``tolerance`` of the target, the splitter stands there and copies stay together; only a group of
copies that reaches further is cut, by a second search over the ids in it. Then rows are exchanged once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._session import stored

SHARDS, TOLERANCE, ROW_BYTES, PROBES, FIRST_PROBES, PIECE = 40, 0.01, 16, 256, 4096, 4_000
BITS = 60
TOP = (1 << BITS) - 1


@dataclass(frozen=True)
class Stretch:
    """Keys from low to high, the bytes below them, and the targets (bytes) that lie inside; of one text, if named."""

    low: int
    high: int
    below: int
    targets: tuple[float, ...]
    text: int | None = None


def key_of(text: Column) -> Column:
    """60 bits of the MD5 of a text; null is as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def counted(rows: DataFrame, key: str, stretches: list[Stretch], probes: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of each stretch what lies between two probes, in order: bytes, least and greatest key. One aggregation, no exchange of rows."""
    found, every = F.lit(None).cast("struct<s: int, p: bigint>"), None
    for s, x in enumerate(stretches):
        inside = F.col(key).between(x.low, x.high) if x.text is None else (F.col("text_key") == x.text) & F.col(key).between(x.low, x.high)
        width = (x.high - x.low) // probes + 1
        place = F.struct(F.lit(s).alias("s"), F.floor((F.col(key) - x.low) / width) if width < 2 else F.expr(f"(`{key}` - {x.low}L) div {width}L")).cast("struct<s: int, p: bigint>")
        every = F.when(inside, place) if every is None else every.when(inside, place)
    at = rows.withColumn("at", found if every is None else every).where("at is not null")
    counts = at.groupBy("at").agg(F.sum("size").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    out: dict[int, list[tuple[int, int, int]]] = {s: [] for s in range(len(stretches))}
    for r in sorted(counts, key=lambda r: (r["at"]["s"], r["at"]["p"])):
        out[r["at"]["s"]].append((int(r["n"]), r["low"], r["high"]))
    return out


def located(rows: DataFrame, key: str, stretches: list[Stretch], *, probes: int = PROBES, first: int = FIRST_PROBES) -> dict[tuple[float, int | None], tuple[int, int, int]]:
    """Of each target the key that it falls on: key, bytes below it and bytes up to its end."""
    found, probe = {}, first
    while stretches:
        counts, rest = counted(rows, key, stretches, probe), {}
        for s, x in enumerate(stretches):
            for target in x.targets:
                below = x.below
                for n, low, high in counts[s]:
                    if below + n >= target:
                        break
                    below += n
                if low == high:
                    found[target, x.text] = low, below, below + n
                else:
                    rest.setdefault((low, high, below, x.text), []).append(target)
        stretches = [Stretch(low, high, below, tuple(t), text) for (low, high, below, text), t in rest.items()]
        probe = probes
    return found


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The last text and row key of each shard but the last. rows: text_key, row_key, size.

    What is collected are counts between probes, no more than 4,096 or 256 a splitter, whatever the number of rows.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total or shards < 2:
        return []
    targets = [total * j / shards for j in range(1, shards)]
    texts = located(rows, "text_key", [Stretch(0, TOP, 0, tuple(dict.fromkeys(targets)))])
    out, cut = {}, {}
    for t in targets:
        key, low, high = texts[t, None]
        if min(t - low, high - t) <= tolerance * total / shards:
            out[t] = (key, -1) if t - low <= high - t else (key, TOP)
        else:
            cut.setdefault((key, low), []).append(t)
    inside = located(rows, "row_key", [Stretch(0, TOP, low, tuple(t), key) for (key, low), t in cut.items()])
    for (key, _), some in cut.items():
        for t in some:
            row, low, high = inside[t, key]
            out[t] = (key, row - 1 if t - low <= high - t else row)
    return [out[t] for t in targets]


def shard_of(split: list[tuple[int, int]]) -> Column:
    """The number of splitters below a row."""
    shard = F.lit(0)
    for text, row in split:
        shard = shard + ((F.col("text_key") > text) | ((F.col("text_key") == text) & (F.col("row_key") > row))).cast("int")
    return shard


def sharded(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, piece: int = PIECE) -> DataFrame:
    """shard, slot (gapless from 0 in each shard), size, text_crc32 and row (all columns of the document).

    Shards differ from the mean by what ``tolerance`` allows and half a document at either end; a document larger than a
    shard fills one and leaves others empty. A null text is as an empty one; a null id is as an empty one, too. Rows alike
    in id and text stay in one shard, in any order. An empty table gives no rows. Slots are counted in pieces of about
    ``piece`` rows, by the key of the id, so that no task numbers a whole shard or a whole group of copies.
    """
    own = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    t, i = F.col(f"`{own[text]}`"), F.col(f"`{own[doc_id]}`")
    rows = docs.toDF(*own.values()).withColumns({"text_key": key_of(t), "row_key": key_of(i), "size": size_of(t), "text_crc32": F.crc32(F.coalesce(t, F.lit("")))})
    keys = stored(rows.select("text_key", "row_key", "size"))
    shard, pieces = shard_of(splitters(keys, shards, tolerance)), max(1, keys.count() // (shards * piece))
    placed = lambda df: df.withColumn("shard", shard).withColumn("piece", F.pmod("row_key", F.lit(pieces)))
    counts = placed(keys).groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("row_key", "text_key")) - 1
    numbered = placed(rows).withColumn("inside", inside).join(counts.select("shard", "piece", before.alias("before")), ["shard", "piece"])
    return numbered.select("shard", (F.col("before") + F.col("inside")).alias("slot"), "size", "text_crc32", F.struct(*(F.col(f"`{k}`").alias(c) for c, k in own.items())).alias("row"))


def write_shards(docs: DataFrame, path: str, *, name: str = "shard", **options) -> None:
    """The documents as Parquet, a folder for each shard; a column of that name gives way to the shard."""
    out = sharded(docs, **options).select(F.col("shard").alias("_shard"), "row.*")
    out.drop(name).withColumnRenamed("_shard", name).write.partitionBy(name).parquet(path)


def op13_shards(spark, sf_dir: str) -> DataFrame:
    """``sharded`` over the whole of documents; the law is bytes, so nothing is said of one more shard."""
    rows = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute_force(docs: list[tuple[int | None, str | None]], shards: int, tolerance: float) -> list[tuple]:
    """doc_id, size, crc32 and shard by walking the rows in order; for small fixtures."""
    import hashlib

    key = lambda x: int(hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()[: BITS // 4], 16)
    rows = sorted((key(t), key(i), len((t or "").encode()) + ROW_BYTES, i, t) for i, t in docs)
    total = sum(r[2] for r in rows)
    edges: dict[int, dict[int, int]] = {1: {0: -1}, 2: {0: -1}}  # bytes below an edge -> rows below it, of texts and of rows
    at = 0
    for k, r in enumerate(rows):
        at += r[2]
        if k + 1 == len(rows) or rows[k + 1][0] != r[0]:
            edges[1][at] = k
        if k + 1 == len(rows) or rows[k + 1][:2] != r[:2]:
            edges[2][at] = k
    ends = []
    for j in range(1, shards):
        t = total * j / shards
        near = min(edges[1], key=lambda e: (abs(e - t), e))
        near = near if abs(near - t) <= tolerance * total / shards else min(edges[2], key=lambda e: (abs(e - t), e))
        ends.append(edges[1].get(near, edges[2].get(near)))
    return [(r[3], r[2], zlib.crc32((r[4] or "").encode()), sum(k > e for e in ends)) for k, r in enumerate(rows)]


#: The same in DuckDB: running sums over the ordered rows instead of probes, CRC-32 byte by byte.
ORACLE_SQL = """
WITH crc AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') x, ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT tk, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT rk, octet_length(encode(coalesce(text, ''))) + 16 size FROM documents),
c AS (SELECT doc_id, x, tk, rk, size, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) s FROM d, crc),
s AS (SELECT sum(size)::BIGINT total, greatest(1, count(*) // 160000) pieces FROM d),
j AS (SELECT j, total * j / 40.0 want, 0.01 * total / 40.0 tol FROM s, range(1, 40) r(j)),
te AS (SELECT tk, tk_end e FROM (SELECT tk, sum(sum(size)) OVER (ORDER BY tk) tk_end FROM d GROUP BY tk) UNION ALL SELECT -1, 0),
re AS (SELECT tk, rk, sum(sum(size)) OVER (ORDER BY tk, rk) e FROM d GROUP BY tk, rk UNION ALL SELECT -1, -1, 0),
near_t AS (SELECT j, want, tol, min_by({tk: tk, e: e}, (abs(e - want), e)) b FROM j, te GROUP BY ALL),
near_r AS (SELECT j, min_by({tk: tk, rk: rk}, (abs(e - want), e)) b FROM j, re GROUP BY j),
cuts AS (SELECT j, CASE WHEN abs(t.b.e - t.want) <= t.tol THEN t.b.tk ELSE r.b.tk END tk, CASE WHEN abs(t.b.e - t.want) <= t.tol THEN 1152921504606846975 ELSE r.b.rk END rk FROM near_t t JOIN near_r r USING (j)),
p AS (SELECT doc_id, size, xor(s, 4294967295) crc, tk, rk, (SELECT count(*) FROM cuts WHERE c.tk > cuts.tk OR c.tk = cuts.tk AND c.rk > cuts.rk) shard FROM c)
SELECT doc_id, size::BIGINT size, crc::BIGINT text_crc32, 'bytes' law, shard::INT shard, row_number() OVER (PARTITION BY shard ORDER BY rk % pieces, rk, tk) - 1 slot, NULL::INT grown_shard FROM p, s
"""

QUERIES = {"op13_shards": (op13_shards, ORACLE_SQL)}
