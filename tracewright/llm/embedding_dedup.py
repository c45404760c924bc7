"""Near duplicates among embeddings by NN-descent.

Neighbour lists begin with random hyperplanes: vectors of one label that fall on the same sides are a bucket. The number of
planes grows with the largest label, so buckets stay about as small as a block, and the number of tables grows with it, so
that a pair at the threshold shares a bucket of one of them with probability 0.98. A bucket of more than a block is
dealt to blocks that all hold its first vector; no two blocks are compared. Then lists are refined again and again: the
neighbours of each vector, in both directions, meet under it, again in blocks that share it, so neighbours of neighbours
find each other. A list that is full of near vectors is saturated and grows twofold; those of lesser likeness keep places
of their own in it. Lists only say who meets next: all near pairs of a meeting join their rows to components, whether a
list has room for them or not, and links are counted exactly inside components: what lies within half the threshold's
angle of one centre is linked throughout, the rest is compared block by block.

The recall is audited twice. A set of planes drawn apart finds pairs by itself, and what share of them was known, for each
size of group, says what is missing, however rare links are; what it finds is added. And a sample of fixed size of each
class of links is compared with all vectors. If either is short, more planes are drawn and lists refined; at last all
blocks of each label are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._graph import components, roots
from tracewright.llm._session import arrow_rows, cut, stored

THRESHOLD, FLOOR, NEIGHBOURS, MOST, BITS, BLOCK, WIDE, SEED, CHANCE = 0.98, 0.9, 8, 32, 8, 256, 1024, 11, 0.98
QUERIES_AUDITED, RECALL, ROUNDS, TURNS = 128, 0.97, 3, 4


def _units(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def vectors(table: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """row, vec_id, label, v (unit vector in double precision, null where it links with nothing) and two hashes of it."""
    arrow_rows(table.sparkSession)
    kind = table.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, labelled in zip(batch.column(2).to_pylist(), batch.column(1).is_valid().to_pylist(), strict=True):
                v = np.array([np.nan if c is None else c for c in x], np.float64) if x and labelled else np.zeros(0)
                norm = np.sqrt((v * v).sum())
                if len(v) and np.isfinite(v).all() and not (0 < norm < np.inf) and np.abs(v).max() > 0:
                    v = v / np.abs(v).max()
                    norm = np.sqrt((v * v).sum())
                out.append((v / norm).tobytes() if len(v) and np.isfinite(v).all() and norm > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "vec_id", "label", "v"])

    rows = table.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("row"))
    return cut(rows.mapInArrow(run, f"row long, vec_id {kind}, label string, v binary").withColumn("c", F.xxhash64("label", "v")).withColumn("d", F.hash("v", "label")))


def _sides(bits: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            side = np.zeros(len(raw), np.int64)
            size = np.array([len(x) for x in raw])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                planes = np.random.default_rng([seed, n]).normal(size=(x.shape[1], bits))
                side[at] = (x @ planes > 0) @ (1 << np.arange(bits)) + n * 1_000_003
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(side)], names=["row", "side"])

    return run


def blocked(df: DataFrame, key: list[str], row: str = "row", block: int = BLOCK) -> DataFrame:
    """Rows of a key dealt to all pairs of its blocks; inside, each pair of rows meets once: k, half (2 for one block)."""
    sizes = df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(row, F.lit(SEED)), F.col("blocks").cast("long")).cast("int")
    rows = df.join(sizes, key).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    k = F.xxhash64(*key, F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.withColumn("k", k).withColumn("half", half).drop("blocks", "mine", "other")


def centred(df: DataFrame, key: list[str], block: int, turn: int = 0) -> DataFrame:
    """Rows of a key dealt to its blocks, about ``block`` rows each, and its first row (of a hash) to each of them: k, half, row.

    Work grows with the rows of a key and not with their square. Who shares a block changes from turn to turn.
    """
    first = F.min(F.struct(F.xxhash64("row", F.lit(SEED + turn)).alias("h"), "row"))
    sizes = df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), first.alias("first"))
    mine = F.pmod(F.xxhash64("row", F.lit(SEED + 7 * turn)), F.col("blocks").cast("long")).cast("int")
    sizes = stored(sizes)
    rows = df.join(sizes.select(*key, "blocks"), key).select(*key, mine.alias("mine"), "row")
    shared = sizes.where("blocks > 1").select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"), F.col("first.row").alias("row"))
    return rows.unionByName(shared).select(F.xxhash64(*key, "mine").alias("k"), F.lit(2).alias("half"), "row").distinct()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by k, one whole group of bounded size after the other."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        k = table.column("k").to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("k")[0].as_py() != int(k[a]):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def similarities(table: pa.Table) -> np.ndarray:
    """Cosines of all rows of a group; of rows that do not meet in it, of other lengths, and of each with itself -2."""
    raw, half = table.column("v").to_pylist(), table.column("half").to_numpy()
    size = np.array([len(x) for x in raw])
    out = np.full((len(raw), len(raw)), -2.0)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
        out[np.ix_(at, at)] = x @ x.T
    out[(half[:, None] == half[None, :]) & (half[:, None] != 2)] = -2
    np.fill_diagonal(out, -2)
    return out


def _best(most: int, floor: float, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row of a group its best others that are near enough to lead anywhere, if all of them are near also the best
    below the threshold; and (s null) the smallest row that it is joined to by near pairs of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            table = table.sort_by("row")
            s, row = similarities(table), table.column("row").to_numpy()
            keep, near = min(most, len(row)), s >= threshold
            root = roots(len(row), *np.nonzero(near))
            joined = row != row[root]
            full = np.flatnonzero(near.sum(axis=1) >= keep)
            a, b, like = [row[joined]], [row[root[joined]]], [np.full(joined.sum(), np.nan)]
            for at, part in ((np.arange(len(row)), s), (full, np.where(near[full], -2, s[full]))):
                top = np.argpartition(-part, keep - 1, axis=1)[:, :keep]
                i, j = np.repeat(np.arange(len(at)), keep), top.ravel()
                yes = (part[i, j] >= floor) & (row[at[i]] != row[j])
                a, b, like = [*a, row[at[i[yes]]]], [*b, row[j[yes]]], [*like, part[i[yes], j[yes]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(like), from_pandas=True)], names=["a", "b", "s"])

    return run


def compared(members: DataFrame, key: list[str], reps: DataFrame, most: int, floor: float, threshold: float, block: int, turn: int = 0) -> DataFrame:
    """a, b, s, joined: what rows that share a key find of each other, in blocks with a row in common."""
    dealt = centred(members, key, block, turn).join(reps.select("row", "v"), "row")
    found = dealt.repartition("k").sortWithinPartitions("k").mapInArrow(_best(most, floor, threshold), "a long, b long, s double")
    return found.withColumn("joined", F.isnull("s"))


def planes(largest: int, threshold: float, block: int, bits: int = BITS) -> tuple[int, int]:
    """How many planes a table has, so that a bucket of the largest label is about half a block, and how many tables."""
    bits = max(bits, math.ceil(math.log2(max(1, largest) / block)) + 1)
    shared = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if shared > CHANCE else math.ceil(math.log(1 - CHANCE) / math.log(1 - shared))


def sided(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """row, label, side and t of each table of planes."""
    drawn = [reps.select("row", "v").mapInArrow(_sides(bits, seed + t), "row long, side long").withColumn("t", F.lit(t)) for t in range(tables)]
    members = drawn[0]
    for d in drawn[1:]:
        members = members.unionByName(d)
    return members.join(reps.select("row", "label"), "row").select("row", "label", "side", "t")


def lists(edges: DataFrame, most: int, threshold: float) -> DataFrame:
    """The best of each list: NEIGHBOURS, twice that for each time it is full of near vectors, most at last, and then as
    many of those below the threshold as if it held no others. What joins rows stays whole, with s null where it is not listed."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("s"), "b"))
    near = F.count(F.when(F.col("s") >= threshold, 1)).over(Window.partitionBy("a"))
    size = F.lit(NEIGHBOURS)
    grown = NEIGHBOURS
    while grown < most:
        size = F.when(F.col("near") >= grown, min(most, 2 * grown)).otherwise(size)
        grown *= 2
    best = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("joined").alias("joined")).withColumn("rank", rank).withColumn("near", near)
    lesser = (F.col("near") >= NEIGHBOURS) & (F.col("s") < threshold) & (F.col("rank") - F.col("near") <= NEIGHBOURS)
    listed = F.col("s").isNotNull() & ((F.col("rank") <= size) | lesser)
    return best.withColumn("s", F.when(listed, F.col("s"))).where(F.col("joined") | F.col("s").isNotNull()).select("a", "b", "s", "joined")


def refine(edges: DataFrame, reps: DataFrame, *, threshold: float, floor: float, most: int, block: int, turns: int = TURNS) -> DataFrame:
    """Neighbours of neighbours meet until lists stay as they are, or for that many turns."""
    edges = cut(lists(edges, most, threshold))
    known = edges.agg(F.count("*"), F.sum("s")).first()
    for turn in range(turns):
        listed = edges.where("s is not null")
        both = listed.select(F.col("a").alias("pivot"), F.col("b").alias("row")).unionByName(listed.select(F.col("b").alias("pivot"), F.col("a").alias("row")))
        members = both.unionByName(both.select("pivot", F.col("pivot").alias("row"))).distinct()
        edges = cut(lists(edges.unionByName(compared(members, ["pivot"], reps, NEIGHBOURS, floor, threshold, block, turn + 1)), most, threshold))
        now = edges.agg(F.count("*"), F.sum("s")).first()
        if now[0] == known[0] and abs((now[1] or 0) - (known[1] or 0)) <= 1e-6 * max(1.0, now[1] or 0):
            break
        known = now
    return edges


def _counted(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, links and root of the rows of a group of one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            near = similarities(table) >= threshold
            row, copies = table.column("row").to_numpy(), table.column("copies").to_numpy()
            root = roots(len(row), *np.nonzero(near))
            links = near @ copies
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(row[has]), pa.array(links[has]), pa.array(row[root[has]])], names=["row", "links", "root"])

    return run


def _inside(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, copies, key and whether the row lies within half the angle of the threshold about its key's centre."""
    least = math.cos(math.acos(threshold) / 2) + 1e-9 if threshold < 1 else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            inside = [len(v) == len(c) and float(np.frombuffer(v, np.float64) @ np.frombuffer(c, np.float64)) >= least for v, c in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(inside, pa.bool_())], names=["row", "copies", "key", "inside"])

    return run


def _counts(members: DataFrame, key: str, reps: DataFrame, threshold: float, block: int) -> DataFrame:
    """row, links and root of the rows of each key.

    Of a key of several blocks, rows within half the angle of its first row are all linked with each other and are only
    counted; what lies outside is compared with all.
    """
    kind = dict(members.dtypes)[key]
    members = stored(members.select("row", F.col(key).alias("key")))
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("centre")))
    large = sizes.where(F.col("size") > block)
    small = blocked(members.join(sizes.where(F.col("size") <= block).select("key"), "key", "left_semi"), ["key"], block=block).select("k", "half", "row")
    if not large.limit(1).count():
        return _met(small, reps, threshold)
    centres = stored(large.join(reps.select(F.col("row").alias("centre"), F.col("v").alias("c")), "centre").select("key", "c"))
    vectors_ = members.join(reps.select("row", "copies", "v"), "row").join(centres, "key").select("row", "copies", "key", "v", "c")
    placed = stored(vectors_.mapInArrow(_inside(threshold), f"row long, copies long, key {kind}, inside boolean"))
    whole = F.when(F.col("inside"), F.col("copies"))
    ball = stored(placed.groupBy("key").agg(F.sum(whole).alias("total"), F.min(F.when(F.col("inside"), F.col("row"))).alias("root"), F.ceil(F.count_if("inside") / block).cast("int").alias("within"), F.ceil(F.count_if(~F.col("inside")) / block).cast("int").alias("beyond")))
    rows = placed.join(ball, "key")
    at = lambda n: F.pmod(F.xxhash64("row", F.lit(SEED)), F.col(n).cast("long")).cast("int")
    every = F.col("within") + F.col("beyond") - 1
    others = F.when(~F.col("inside"), F.sequence(F.lit(0), every)).when(F.col("beyond") > 0, F.sequence("within", every))
    dealt = rows.withColumn("mine", F.when(F.col("inside"), at("within")).otherwise(F.col("within") + at("beyond"))).withColumn("other", F.explode(others))
    half = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("ball")).alias("k"), half.alias("half"), "row")
    counted_ = rows.where("inside").select("row", (F.col("total") - F.col("copies")).alias("links"), "root").where("links > 0")
    return _met(small.unionByName(dealt), reps, threshold).unionByName(counted_)


def _met(dealt: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    rows = dealt.join(reps.select("row", "v", "copies"), "row")
    return cut(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_counted(threshold), "row long, links long, root long"))


def counted(edges: DataFrame, reps: DataFrame, *, threshold: float, block: int) -> DataFrame:
    """row, links and root: exact counts inside the components of the links found."""
    return _counts(components(edges.where("joined").select("a", "b")).withColumnRenamed("vertex", "row"), "component", reps, threshold, block)


def exact(reps: DataFrame, *, threshold: float, block: int = WIDE) -> DataFrame:
    """row, links and root of all pairs of each label."""
    return _counts(reps.select("row", "label"), "label", reps, threshold, block)


def known_share(edges: DataFrame, apart: DataFrame) -> float:
    """Of the pairs that planes drawn apart have joined, the share that was in one component: the least of all sizes of group.

    Sizes are those of components with both; they double from class to class. Without any pair apart nothing is missing that
    planes find with probability 0.98 each time.
    """
    near = lambda e: e.where("joined").select("a", "b")  # noqa: E731  what is near is joined where it met
    old, both = components(near(edges)), components(near(edges).unionByName(near(apart)))
    sizes = both.groupBy("component").agg(F.floor(F.log2(F.count("*"))).alias("class"))
    classed = both.join(sizes, "component").join(old.withColumnRenamed("component", "old"), "vertex", "left").select("vertex", "class", F.coalesce("old", "vertex").alias("old"))
    ends = near(apart).join(classed.select(F.col("vertex").alias("a"), "class", F.col("old").alias("of_a")), "a").join(classed.select(F.col("vertex").alias("b"), F.col("old").alias("of_b")), "b")
    least = ends.groupBy("class").agg(F.avg((F.col("of_a") == F.col("of_b")).cast("int")).alias("known")).agg(F.min("known")).first()[0]
    return 1.0 if least is None else float(least)


def audit(reps: DataFrame, links: DataFrame, *, threshold: float, queries: int = QUERIES_AUDITED) -> float | None:
    """The mean share of a vector's links, against all vectors, that are found: the least of all sizes of group.

    About that many vectors of smallest hash are asked of each class of links found, whatever the table's length; means are
    over the vectors of each class of true links. Classes double. None if no vector asked has a link: nothing is known.
    """
    got = reps.join(links.groupBy("row").agg(F.sum("links").alias("links")), "row", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    got = got.withColumn("class", F.floor(F.log2(F.col("links") + 1)))
    sizes = {r["class"]: r["count"] for r in got.groupBy("class").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, queries / n))))[F.col("class")]
    asked = F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30)
    sample = got.where(asked).select("row", "label", "v", "links").collect()
    shared = reps.sparkSession.sparkContext.broadcast([(r["row"], r["label"], bytes(r["v"])) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        for r, lab, v in shared.value:
            wanted.setdefault((lab, len(v)), []).append((r, v))
        sets = {k: (np.array([r for r, _ in q]), np.frombuffer(b"".join(v for _, v in q), np.float64).reshape(len(q), -1)) for k, q in wanted.items()}
        total = {k: np.zeros(len(r), np.int64) for k, (r, _) in sets.items()}
        for batch in batches:
            row, label, raw, copies = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
            places: dict[tuple[str, int], list[int]] = {}
            for i, (lab, v) in enumerate(zip(label, raw, strict=True)):
                places.setdefault((lab, len(v)), []).append(i)
            for k in places.keys() & sets.keys():
                at, (r, q) = places[k], sets[k]
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                total[k] += copies[at] @ ((x @ q.T >= threshold) & (row[at][:, None] != r[None, :]))
        for k, (r, _) in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array(r[total[k] > 0]), pa.array(total[k][total[k] > 0])], names=["row", "n"])

    true = {r["row"]: r["n"] for r in reps.select("row", "label", "v", "copies").mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()}
    shares: dict[int, list[float]] = {}
    for r in sample:
        if n := true.get(r["row"]):
            shares.setdefault(int(math.log2(n + 1)), []).append(min(n, r["links"]) / n)
    return min((sum(x) / len(x) for x in shares.values()), default=None)


def near_embeddings(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, floor: float = FLOOR, bits: int = BITS, most: int = MOST, block: int = BLOCK, recall: float = RECALL, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept.

    Vectors of one label are linked if their cosine is threshold or more; vectors without label, null, zero, or with
    null or non-finite parts are linked with nothing. Identical vectors are compared once and counted. Vectors of
    other lengths never meet. Repeated rows are linked with each other; other columns are not read. If the audit still
    finds too little after all rounds, all vectors of each label are compared.
    """
    rows = vectors(table, vec_id, embedding, label)
    classes = rows.where("v is not null").groupBy("c", "d").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    reps = cut(rows.select("row", "label", "v").join(classes.select("row", "copies"), "row"))
    sizes = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    bits, tables = planes(sizes or 0, threshold, block, bits)
    key, edges = ["t", "label", "side"], None
    meet = lambda seed: compared(sided(reps, bits, tables, seed), key, reps, NEIGHBOURS, floor, threshold, block)
    for r in range(rounds):
        fresh = meet(SEED + 1000 * r)
        edges = refine(fresh if edges is None else edges.unionByName(fresh), reps, threshold=threshold, floor=floor, most=most, block=block)
        apart = stored(meet(SEED + 1000 * r + 500))
        share = known_share(edges, apart)
        edges = cut(lists(edges.unionByName(apart), most, threshold))
        links = counted(edges, reps, threshold=threshold, block=block)
        seen = audit(reps, links, threshold=threshold) if share >= recall else None
        if share >= recall and (seen is None or seen >= recall):
            break
    else:
        links = exact(reps, threshold=threshold)
    found = components(links.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("vertex", "row")
    totals = links.groupBy("row").agg(F.sum("links").alias("links"))
    info = classes.join(totals, "row", "left").join(found, "row", "left").select("c", "d", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "row").alias("component"))
    full = rows.where("v is not null").drop("v").join(info, ["c", "d"]).select("row", "vec_id", "n_links", "component")
    full = full.unionByName(rows.where("v is null").select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("row").alias("component")))
    full = stored(full)
    heads = stored(full.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    return full.join(heads, "component").select("vec_id", "n_links", "component_id", same(F.col("vec_id"), F.col("component_id")).alias("kept"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of every row of embeddings."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in DuckDB, by all pairs of equal labels.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT vec_id a, vec_id b FROM embeddings UNION SELECT r.a, o.b FROM reach r JOIN pair o ON o.a = r.b),
part AS (SELECT a vec_id, min(b) component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept FROM part LEFT JOIN (SELECT a vec_id, count(*) n FROM pair GROUP BY 1) USING (vec_id)
"""

QUERIES = {"op8_embedding_dedup": (op8_embedding_dedup, ORACLE_SQL)}
