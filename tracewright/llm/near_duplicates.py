"""Near duplicates by n-gram Jaccard similarity, with Bayesian pruning of candidates.

Texts are sets of five-word shingles of lower-cased words. Texts of one word sequence form a class and are compared
once. Classes that agree in a band of MinHash values meet; their values are compared step by step, and a pair is
dropped as soon as the posterior probability (uniform prior) of similarity ``THRESHOLD`` falls below ``TOLERANCE``.
All other pairs are verified on their whole shingle sets.

Pairs never become rows. A bucket is named after its smallest class, and classes meet once under each such name, with
their MinHash values, in pairs of blocks where the name has many; what meets under several names is compared under the
smallest. Pruning tells which labels a class has candidates under, its own label being the smallest of its names. For
verification a text goes to its label once and is written as its difference from the label's own shingles, exact and a
few numbers long among near copies; only these go to pairs of blocks, where the sets are put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._graph import components, roots
from tracewright.llm._session import arrow_rows, cut, stored

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP, BLOCK, WIDE, SEED = 24, 4, 16, 192, 512, 99
HASHES = BANDS * ROWS
SPACES = A.word_table(lower_ascii_words=False)
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(k, m): a pair with fewer than m of k equal values is dropped. P(J >= t | m of k) is a tail of Beta(m+1, k-m+1)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        for m in range(k + 1):
            density = m * np.log(grid) + (k - m) * np.log(1 - grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append((k, m))
                break
    return out


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, first shingle of each row, words of each row, and two hashes of its word sequence.

    A text of fewer words than n, but not none, is one shingle. Letters A-Z are lowered byte by byte, others by the caller.
    """
    data, offsets = A.text_bytes(column)
    data = A.lower_table()[data]
    starts, ends, first = A.word_bounds(data, offsets, SPACES)
    h = A.word_hashes(data, starts, ends)
    prefix, other = A.Prefix(h, A.BASE_WORDS), A.Prefix(h, A.BASE_CHECK)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(1, words - n + 1), 0)
    at = A.spread(first[:-1], count)
    return prefix.hashes(at, at + np.repeat(np.minimum(words, n), count)), np.append(0, np.cumsum(count)), words, prefix.hashes(first[:-1], first[1:]), other.hashes(first[:-1], first[1:])


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits) of each row that has shingles."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        with np.errstate(over="ignore"):
            for k, c in enumerate(MULTIPLIERS):
                out[full, k] = np.minimum.reduceat(s * c, bounds[full]) >> np.uint64(32)
    return out


def candidates(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs stay, comparing STEP more values each time."""
    alive, equal, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for k, m in steps:
        equal = equal + (sigs[i[alive], done:k] == sigs[j[alive], done:k]).sum(1)
        keep = equal >= m
        alive, equal, done = alive[keep], equal[keep], k
    return alive


def bands_equal(sigs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (sigs[i] == sigs[j]).reshape(-1, BANDS, ROWS).all(2)


def pairs_of(sizes: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each group of consecutive rows: all of one block, or those across two (sides 0 and 1)."""
    start = np.append(0, np.cumsum(sizes))
    for n in np.unique(sizes):
        if n < 2:
            continue
        i, j = np.triu_indices(int(n), 1)
        groups = start[:-1][sizes == n]
        per = max(1, 200_000 // len(i))
        for a in range(0, len(groups), per):
            g = groups[a : a + per, None]
            x, y = (g + i).ravel(), (g + j).ravel()
            yes = (side[x] != side[y]) | (side[x] == 2)
            yield x[yes], y[yes]


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups of about that many bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        opens = np.flatnonzero(_opens(table, key))
        if opens[-1]:
            yield table.slice(0, int(opens[-1]))
            held = table.slice(int(opens[-1])).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _opens(table: pa.Table, key: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for k in key:
        v = table.column(k).to_numpy()
        fresh[1:] |= v[1:] != v[:-1]
    return fresh


def blocked(df: DataFrame, key: list[str], size: str, block: int = BLOCK) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: block_a, block_b and side (0, 1, or 2 where both are one block)."""
    count = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("row", F.lit(SEED)), count.cast("long")).cast("int")
    rows = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return rows.withColumn("block_a", F.least("mine", "other")).withColumn("block_b", F.greatest("mine", "other")).withColumn("side", side).drop("mine", "other", size)


def described(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """row, doc_id, h, c and d (hashes of the word sequence), words and sig of each document."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    t = F.col(f"`{text}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            s, bounds, words, c, d = shingles(batch.column(2), n)
            sigs = signatures(s, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(c.view(np.int64)), pa.array(d.view(np.int64)), pa.array(words), pa.array([x.tobytes() for x in sigs], pa.binary())], names=["row", "doc_id", "h", "c", "d", "words", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.lower(t).alias("text"), F.xxhash64(t).alias("h"))
    return stored(rows.mapInArrow(run, f"row long, doc_id {kind}, h long, c long, d long, words long, sig binary"))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = _matrix(batch.column(1))
        m = len(sigs)
        x = np.zeros((m, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                x = A.mixed(x * np.uint64(31) + sigs.reshape(m, BANDS, ROWS)[:, :, k] + np.arange(BANDS, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), m)), pa.array(x.ravel().view(np.int64))], names=["row", "band", "bucket"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _under_smaller(names: pa.Array, name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have a name in common that is smaller than the one they meet under here."""
    values, bounds = names.flatten().to_numpy(), names.offsets.to_numpy()
    count = np.diff(bounds)
    most = int(count.max())
    table = np.full((len(count), most), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(count)), count)
    table[row, np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], count)] = values
    own = table < name[:, None]
    some = own.any(1)
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(some[i] & some[j])
    for x in range(most if len(at) else 0):
        for y in range(most):
            out[at] |= own[i[at], x] & (table[i[at], x] == table[j[at], y])
    return out


def _met(steps: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes by name in, (low, high, row) out: the pairs of labels under which a class has candidates."""
    key = ["name", "block_a", "block_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, 1 << 21):
            opens = np.flatnonzero(_opens(table, key))
            sigs, side = _matrix(table.column("sig").combine_chunks()), table.column("side").to_numpy()
            row, label, name = (table.column(x).to_numpy() for x in ("row", "label", "name"))
            names = table.column("names").combine_chunks()
            found = [np.zeros((3, 0), np.int64)]
            for i, j in pairs_of(np.diff(np.append(opens, table.num_rows)), side):
                alive = candidates(sigs, i, j, steps)
                i, j = i[alive], j[alive]
                mine = bands_equal(sigs, i, j).any(1) & ~_under_smaller(names, name, i, j)
                i, j = i[mine], j[mine]
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                found.append(np.unique(np.concatenate([np.stack([low, high, row[i]]), np.stack([low, high, row[j]])], axis=1), axis=1))
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["low", "high", "row"])

    return run


def _bases(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row and text in, label and its ordered shingles out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            s, bounds, *_ = shingles(batch.column(1), n)
            sets = [np.unique(s[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "base"])

    return run


def _differences(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, label, copies, text and base in; out come, instead of the text, the places of the base that it lacks and what it has besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            s, bounds, *_ = shingles(batch.column(3), n)
            missing, extra = [], []
            for k in range(batch.num_rows):
                own, base = np.unique(s[bounds[k] : bounds[k + 1]]), np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                missing.append(np.flatnonzero(A.member(base, own) < 0).astype(np.int32).tobytes())
                extra.append(own[A.member(own, base) < 0].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(missing, pa.binary()), pa.array(extra, pa.binary())], names=["row", "label", "copies", "missing", "extra"])

    return run


def _verified(threshold: float, steps: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Differences by pair of labels in, and the labels' shingles (row null); (row, links, root) out: documents linked with the class, and a link that joins it."""
    key = ["low", "high", "block_a", "block_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, 1 << 19):
            group = np.cumsum(_opens(table, key)) - 1
            is_base = table.column("row").is_null().to_numpy()
            known = {(g, x): np.frombuffer(b, np.uint64) for g, x, b in zip(group[is_base].tolist(), table.column("label").to_numpy()[is_base].tolist(), table.column("base").filter(pa.array(is_base)).to_pylist(), strict=True)}
            table, group = table.filter(pa.array(~is_base)), group[~is_base]
            if not table.num_rows:
                continue
            side, row, label, copies, low, high = (table.column(x).to_numpy() for x in ("side", "row", "label", "copies", "low", "high"))
            sets = []
            for g, x, missing, extra in zip(group.tolist(), label.tolist(), table.column("missing").to_pylist(), table.column("extra").to_pylist(), strict=True):
                sets.append(np.sort(np.concatenate([np.delete(known[g, x], np.frombuffer(missing, np.int32)), np.frombuffer(extra, np.uint64)])))
            size = np.array([len(x) for x in sets])
            sigs = signatures(np.concatenate(sets), np.append(0, np.cumsum(size)))
            links, joined = np.zeros(len(row), np.int64), [np.zeros((2, 0), np.int64)]
            for i, j in pairs_of(np.bincount(group)[np.unique(group)], side):
                mine = (np.minimum(label[i], label[j]) == low[i]) & (np.maximum(label[i], label[j]) == high[i])
                mine &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                i, j = i[mine], j[mine]
                alive = candidates(sigs, i, j, steps)
                i, j = i[alive], j[alive]
                met = bands_equal(sigs, i, j).any(1)
                i, j = i[met], j[met]
                shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
                yes = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
                i, j = i[yes], j[yes]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                joined.append(np.stack([i, j]))
            a, b = np.concatenate(joined, axis=1)
            root = roots(len(row), a, b)
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(row[has]), pa.array(links[has]), pa.array(row[root[has]])], names=["row", "links", "root"])

    return run


def _linked(docs: DataFrame, doc_id: str, text: str, known: DataFrame, met: DataFrame, repeated: bool, n: int, threshold: float, steps: list[tuple[int, int]]) -> DataFrame:
    """row, links and root of the classes met, verified on their texts."""
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h")).alias("t")
    rows = met.select("row").unionByName(met.select(F.col("low").alias("row"))).unionByName(met.select(F.col("high").alias("row"))).distinct()
    wanted = known.select("row", "doc_id", "h", "copies", "label").join(rows, "row", "left_semi").alias("k").hint("shuffle_hash")
    held = texts.join(wanted, F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.h") == F.col("k.h"))).select("row", "label", "copies", "text")
    held = stored(held.dropDuplicates(["row"]) if repeated else held)
    bases = stored(held.where("row = label").select("row", "text").mapInArrow(_bases(n), "label long, base binary"))
    kinds = "row long, label long, copies long, missing binary, extra binary"
    apart = stored(held.join(bases, "label").select("row", "label", "copies", "text", "base").mapInArrow(_differences(n), kinds))
    sizes = stored(met.groupBy("low", "high").agg(F.count("*").alias("size")))
    dealt = blocked(met.join(sizes, ["low", "high"]), ["low", "high"], "size")
    key = ["low", "high", "block_a", "block_b"]
    ends = dealt.select(*key).distinct().withColumn("label", F.explode(F.array_distinct(F.array("low", "high")))).join(bases, "label")
    rows = dealt.join(apart, "row").unionByName(ends, allowMissingColumns=True).select(*key, "side", "row", "label", "copies", "missing", "extra", "base")
    return cut(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verified(threshold, steps), "row long, links long, root long"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: doc_id, h, class_id (smallest doc_id reachable by links), n_links (documents linked with it), first.

    Two documents are linked if their sets of n-word shingles have a Jaccard similarity of threshold or more; copies
    of one word sequence are linked too. A text of fewer than n words is one shingle; a null, empty or blank text is
    linked with nothing. ``first`` is true for one row of each class: of the smallest id, for repeated rows any one.
    """
    steps = least_matches(threshold, tolerance)
    rows = described(docs, doc_id, text, n)
    classes = rows.where("words > 0").groupBy("c", "d").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = stored(classes)
    reps = rows.join(classes.select("row", "copies"), "row").select("row", "doc_id", "h", "copies", "sig")
    bands = reps.select("row", "sig").mapInArrow(_banded, "row long, band int, bucket long")
    buckets = stored(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("row").alias("name")).where("size > 1").drop("size"))
    members = stored(bands.join(buckets, "bucket").select("row", "name").distinct())
    labels = members.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumn("label", F.get("names", F.lit(0)))
    known = stored(reps.join(labels, "row"))
    sizes = stored(members.groupBy("name").agg(F.count("*").alias("size")))
    dealt = blocked(members.join(sizes, "name").join(known.select("row", "label", "names", "sig"), "row"), ["name"], "size", WIDE)
    key = ["name", "block_a", "block_b"]
    met = stored(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_met(steps), "low long, high long, row long").distinct())
    linked = _linked(docs, doc_id, text, known, met, _repeated(rows), n, threshold, steps)
    groups = components(linked.select(F.col("row").alias("a"), F.col("root").alias("b")))
    totals = linked.groupBy("row").agg(F.sum("links").alias("links"))
    info = classes.join(totals, "row", "left").join(groups.withColumnRenamed("vertex", "row"), "row", "left").select("c", "d", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "row").alias("component"))
    full = rows.drop("sig").join(info, ["c", "d"], "left").where("words > 0").unionByName(rows.where("words = 0").drop("sig").withColumn("n_links", F.lit(0).cast("long")).withColumn("component", F.col("row")))
    full = stored(full)
    heads = stored(full.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")))
    return full.join(heads, "component").select("doc_id", "h", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("head.row")).alias("first"))


def _repeated(rows: DataFrame) -> bool:
    """Whether any id and text stand in two rows; then the text of a class has to be taken from one of them."""
    return bool(rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count())


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one row left of each class; rows without words all stay."""
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("first").groupBy("doc_id", "h").agg(F.count("*").alias("n")).alias("k")
    d = docs.alias("d")
    joined = d.join(kept.hint("shuffle_hash"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("k.h")))
    nth = F.row_number().over(Window.partitionBy(F.col("k.doc_id"), F.col("k.h")).orderBy(F.lit(1)))
    rows = joined.select(F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("d"), nth.alias("nth"), F.col("k.n").alias("n"))
    return rows.where("nth <= n").select("d.*")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Class and links of every row of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


#: The same in DuckDB, by all pairs of texts that share a shingle, and by everything that can be reached.
ORACLE_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) c FROM sh x JOIN sh y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2) JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE c >= 0.8 * (s.n + t.n - c) - 1e-9),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, o.b FROM reach r JOIN pair o ON o.a = r.b)
SELECT doc_id, class_id, coalesce(n, 0) n_links FROM (SELECT a doc_id, min(b) class_id FROM reach GROUP BY 1) LEFT JOIN (SELECT a doc_id, count(*) n FROM pair GROUP BY 1) USING (doc_id)
"""

QUERIES = {"op4_near_duplicates": (op4_near_duplicates, ORACLE_SQL)}
