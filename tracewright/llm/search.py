"""Ranked lexical search over a length-stratified index.

Documents of one normaliser m are a stratum. A stratum is indexed in blocks of a bounded number of documents and terms:
the block's vocabulary, and the postings of each term grouped by tf. In a block all that a score depends on beside the
term is tf, so impacts are computed once per tf and added to whole groups of postings. The greatest tf of each term
bounds what any document of a block can score. A query visits the strata of greatest bound first; the tenth best score
found there is what the bound of any other stratum has to reach to be visited at all. The result is exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows, stored

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Fixed values of the score.
SCALE, TF_WEIGHT, M_WEIGHT, BASE, SLOPE = 1_000_000_000, 1000, 8, 10, 90
TOP, BLOCK_DOCS, BLOCK_TERMS, QUERY_TERMS, LEAD, CELLS, STRATA = 10, 1024, 1 << 18, 100_000, 64, 1 << 21, 1 << 20
LAST = (1 << 63) - 1
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))
INDEX = "m long, docs array<long>, terms array<binary>, peaks array<int>, dfs array<int>, groups array<int>, tfs array<int>, ends array<int>, postings array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: letters, digits and all beyond ASCII, A-Z lower-cased."""
    return text.translate(FOLD).split()


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (TF_WEIGHT * tf + M_WEIGHT * m)


def counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (a null one is the greatest), text (binary) and n, its number of terms with repeats, of documents that have any."""
    table = A.word_table(lower_ascii_words=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            n = np.diff(A.word_bounds(*A.text_bytes(batch.column(1)), table)[2])
            yield pa.record_batch([*batch.columns, pa.array(n)], ["doc_id", "text", "n"]).filter(pa.array(n > 0))

    arrow_rows(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text binary, n long")


def statistics(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """n and count of documents by number of terms; N and L."""
    sizes = stored(rows.groupBy("n").agg(F.count("*").alias("count")))
    total = sizes.agg(F.sum("count").alias("N"), F.sum(F.col("n") * F.col("count")).alias("L")).first()
    return sizes, int(total["N"] or 0), int(total["L"] or 0)


def _block(m: int, docs: list[int], texts: list[list[bytes]]) -> dict:
    """One row of the index: documents in order of id, terms in order, and for each term its groups of equal tf."""
    order = sorted(range(len(docs)), key=docs.__getitem__)
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(t, len(number)) for k in order for t in texts[k]], np.int64)
    owner = np.repeat(np.arange(len(order)), [len(texts[k]) for k in order])
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[t] for t in names]] = np.arange(len(names))
    cell, tf = np.unique(place[flat] * len(order) + owner, return_counts=True)
    term, doc = cell // len(order), cell % len(order)
    by = np.lexsort((doc, tf, term))
    term, doc, tf = term[by], doc[by], tf[by]
    last = np.flatnonzero(np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True))
    return {
        "m": m, "docs": [docs[k] for k in order], "terms": names, "dfs": np.bincount(term, minlength=len(names)).astype(np.int32), "peaks": tf[np.flatnonzero(np.append(term[1:] != term[:-1], True))].astype(np.int32),
        "groups": np.cumsum(np.bincount(term[last], minlength=len(names))).astype(np.int32), "tfs": tf[last].astype(np.int32), "ends": (last + 1).astype(np.int32), "postings": doc.astype(np.int32),
    }


_LISTS = {"docs": pa.int64(), "terms": pa.binary(), "peaks": pa.int32(), "dfs": pa.int32(), "groups": pa.int32(), "tfs": pa.int32(), "ends": pa.int32(), "postings": pa.int32()}


def _row(block: dict) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(block[c])], pa.int32()), pa.array(block[c], kind)) for c, kind in _LISTS.items()]
    return pa.record_batch([pa.array([block["m"]], pa.int64()), *lists], ["m", *_LISTS])


def index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """The index as a written table, a row a block, and N. Documents without a term are in no stratum.

    Documents are dealt by stratum and, within it, by slices of a hash of the id, as many as its documents and terms ask
    for. A task sorts its slices and closes a block when the stratum ends or the block is full. A null id stands last.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")  # rows of the index are large
    rows = counted(docs, doc_id, text)
    sizes, n_docs, n_terms = statistics(rows)
    m = F.lit(BASE) + F.expr(f"({SLOPE} * n * {n_docs}L) div {max(1, n_terms)}L")
    slices = sizes.groupBy(m.alias("m")).agg(F.ceil(F.greatest(F.sum("count") / block_docs, F.sum(F.col("n") * F.col("count")) / block_terms)).cast("long").alias("slices"))
    slices = stored(slices)
    slices = F.broadcast(slices) if slices.count() <= STRATA else slices  # a row a stratum, 16 bytes
    dealt = rows.select("doc_id", "text", m.alias("m")).join(slices, "m").select("m", F.pmod(F.xxhash64("doc_id"), "slices").alias("slice"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts, held = None, [], [], 0
        for batch in A.slices(batches, "text"):
            for now, k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                terms = terms_of(text)
                if ids and (now != at or len(ids) >= 2 * block_docs or held + len(terms) > 2 * block_terms):
                    yield _row(_block(at, ids, texts))
                    ids, texts, held = [], [], 0
                at = now
                ids.append(k)
                texts.append(terms)
                held += len(terms)
        if ids:
            yield _row(_block(at, ids, texts))

    return stored(dealt.repartition("m", "slice").sortWithinPartitions("m", "slice").mapInArrow(run, INDEX)), n_docs


def queries_of(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term (binary) of each item's terms, once each; items of one id are one item."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(TERM), F.lit(0))).alias("term"))
    return rows.select("item_id", F.encode(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8").alias("term")).distinct()


def weighted(terms: DataFrame, blocks: DataFrame, n_docs: int) -> DataFrame:
    """Adds the weight of each term that stands in a document; df is summed over blocks."""
    wanted = terms.select("term").distinct()
    df = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df")).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return terms.join(df, "term").withColumn("w", F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long"))


class Queries:
    """A bounded number of items as arrays: distinct terms, and for each pair of item and term their numbers and weight."""

    def __init__(self, rows: list) -> None:
        self.ids = list(dict.fromkeys(r["item_id"] for r in rows))
        item = {x: k for k, x in enumerate(self.ids)}
        self.terms = list(dict.fromkeys(bytes(r["term"]) for r in rows))
        term = {x: k for k, x in enumerate(self.terms)}
        pairs = sorted((item[r["item_id"]], term[bytes(r["term"])], r["w"]) for r in rows)
        self.item, self.term, self.weight = (np.array([p[k] for p in pairs], np.int64) for k in range(3))

    def bounds(self, m: int, peak: np.ndarray) -> np.ndarray:
        """What a document of a block can score at most, by item; peak: the greatest tf of each term, 0 if it is not there."""
        each = self.weight * impacts(peak, m)[self.term]
        return np.bincount(self.item, each, len(self.ids)).astype(np.int64)  # below 2^53, so exact


def _found(queries: Queries, terms: pa.Array) -> np.ndarray:
    """The place of each query term in a block's vocabulary, -1 if it is not there."""
    return pc.fill_null(pc.index_in(pa.array(queries.terms, pa.binary()), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def stratum_bounds(blocks: DataFrame, queries: Queries) -> DataFrame:
    """item, m, bound and n (documents) of each stratum that can score for an item."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                m, terms, peaks = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                at = _found(q, terms)
                bound = q.bounds(m, np.where(at >= 0, peaks[at], 0))
                items = np.flatnonzero(bound)
                yield pa.record_batch([pa.array(items), pa.array(np.full(len(items), m)), pa.array(bound[items]), pa.array(np.full(len(items), batch.column(3)[k].as_py(), np.int64))], ["item", "m", "bound", "n"])

    found = blocks.select("m", "terms", "peaks", F.size("docs").cast("long").alias("n")).mapInArrow(run, "item long, m long, bound long, n long")
    return found.groupBy("item", "m").agg(F.max("bound").alias("bound"), F.sum("n").alias("n"))


def _scores(q: Queries, items: np.ndarray, at: np.ndarray, m: int, row: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of some items, and a score of each of them for each document of a block, in pieces of bounded size."""
    n_docs, groups, tfs, ends, postings = len(row["docs"]), row["groups"], row["tfs"], row["ends"], row["postings"]
    impact = impacts(tfs, m)  # once per tf of a term
    each = np.repeat(impact, np.diff(ends, prepend=0))
    stop = ends[groups - 1].astype(np.int64)
    start = np.append(0, stop[:-1])
    chosen = np.isin(q.item, items) & (at[q.term] >= 0)
    item, place, weight = q.item[chosen], at[q.term[chosen]], q.weight[chosen]
    length = stop[place] - start[place]
    last = np.append(np.flatnonzero(item[1:] != item[:-1]), len(item) - 1) if len(item) else np.zeros(0, np.int64)
    cost = np.cumsum(length)
    first = 0
    while first < len(item):
        fit = last[(last >= first) & ((cost[last] - cost[first] + length[first] <= CELLS) & (item[last] - item[first] < max(1, CELLS // n_docs)))]
        end = int(fit[-1] if len(fit) else last[last >= first][0]) + 1
        here, n = slice(first, end), length[first:end]
        flat = np.repeat(start[place[here]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
        some, own = np.unique(item[here], return_inverse=True)
        cell = np.repeat(own, n) * n_docs + postings[flat]
        # sums stay below 2^53, so doubles hold them exactly
        scores = np.bincount(cell, np.repeat(weight[here], n) * each[flat].astype(np.float64), len(some) * n_docs)
        yield some, scores.reshape(len(some), n_docs)
        first = end


def visited(blocks: DataFrame, queries: Queries, least: np.ndarray, only: dict[int, list[int]] | None, without: dict[int, list[int]] | None, top: int) -> DataFrame:
    """item, doc_id and score: of each task the best documents of each item, from blocks that can still reach ``least``.

    only, without: stratum -> items that visit it, or have been there.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((queries, least, only, without))
    rows = blocks.where(F.col("m").isin(sorted(only))) if only is not None else blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor, some, seen = shared.value
        score = np.zeros((len(q.ids), top), np.int64)
        doc = np.full((len(q.ids), top), LAST, np.int64)
        full = np.maximum(floor, 1)
        for batch in batches:
            columns = batch.schema.names
            for k in range(batch.num_rows):
                value = {c: batch.column(columns.index(c))[k] for c in columns}
                m, terms = value["m"].as_py(), value["terms"].values
                row = {c: value[c].values.to_numpy() for c in columns if c not in ("m", "terms")}
                at = _found(q, terms)
                able = q.bounds(m, np.where(at >= 0, row["peaks"][at], 0)) >= np.maximum(full, score[:, -1])
                if some is not None:
                    able &= np.isin(np.arange(len(able)), some.get(m, []))
                if seen is not None:
                    able &= ~np.isin(np.arange(len(able)), seen.get(m, []))
                items = np.flatnonzero(able)
                for own, scores in _scores(q, items, at, m, row) if len(items) else ():
                    a, b = np.nonzero(scores >= np.maximum(full[own], score[own, -1])[:, None])
                    if not len(a):
                        continue
                    changed = np.unique(a)
                    who = np.concatenate([a, np.repeat(changed, top)])
                    s = np.concatenate([scores[a, b].astype(np.int64), score[own[changed]].ravel()])
                    d = np.concatenate([row["docs"][b], doc[own[changed]].ravel()])
                    by = np.lexsort((d, -s, who))
                    rank = np.arange(len(by)) - np.searchsorted(who[by], who[by])
                    kept = by[rank < top]
                    score[own[changed]], doc[own[changed]] = s[kept].reshape(-1, top), d[kept].reshape(-1, top)
        item, place = np.nonzero(score)
        yield pa.record_batch([pa.array(item), pa.array(doc[item, place]), pa.array(score[item, place])], ["item", "doc_id", "score"])

    return rows.select("m", *_LISTS).drop("dfs").mapInArrow(run, "item long, doc_id long, score long")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each item, by score and then by id; what tasks have found is cut down before it is exchanged."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def _searched(blocks: DataFrame, rows: list, top: int, lead: int) -> DataFrame:
    """The ranking of a bounded set of items, in two visits: the strata of greatest bound, then all that can still matter."""
    q = Queries(rows)
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    strata = stratum_bounds(blocks, q).withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("place", F.row_number().over(order))
    first: dict[int, list[int]] = {}
    for r in strata.where((F.col("before") < lead * top) & (F.col("place") <= lead)).collect():  # no more than ``lead`` an item
        first.setdefault(r["m"], []).append(r["item"])
    some = stored(best(visited(blocks, q, np.zeros(len(q.ids), np.int64), first, None, top), top).select("item", "doc_id", "score", "rank"))
    least = np.zeros(len(q.ids), np.int64)
    for r in some.where(F.col("rank") == top).collect():  # one row an item
        least[r["item"]] = r["score"]
    rest = visited(blocks, q, least, None, first, top)
    return best(some.drop("rank").unionByName(rest), top).select(F.col("item"), "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, query_terms: int = QUERY_TERMS, lead: int = LEAD, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item with a score above 0.

    A null text has no terms, items without terms get no rows, and repeated rows rank each. Equal scores stand in order of
    the id, a null one last. Items go out in groups of about ``query_terms`` terms, one after another, since each group
    is sent to all tasks. Other columns are not read.
    """
    blocks, n_docs = index(docs, doc_id=doc_id, text=text, block_docs=block_docs, block_terms=block_terms)
    terms = stored(weighted(queries_of(items, item_id=item_id, text=item_text), blocks, n_docs))
    groups = -(-terms.count() // query_terms)
    kind = StructType([StructField("item", LongType()), StructField("item_id", terms.schema["item_id"].dataType)])
    out = terms.sparkSession.createDataFrame([], StructType([*kind.fields[1:], StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    for g in range(groups):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # about query_terms of them
        if rows:
            ranked, ids = _searched(blocks, rows, top, lead), list(dict.fromkeys(r["item_id"] for r in rows))
            names = terms.sparkSession.createDataFrame(list(enumerate(ids)), kind)
            out = out.unionByName(ranked.join(F.broadcast(names), "item").drop("item"))
    return out


def op11_search(spark, sf_dir: str) -> DataFrame:
    """``search`` of all documents for each item of benchmark."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[int, str | None]], top: int = TOP) -> list[tuple]:
    """The rows of ``search`` by scoring every document for every item; for small fixtures."""
    found = [(LAST if i is None else i, Counter(re.findall(TERM, _lower(t or "")))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted: dict[int, set[str]] = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(re.findall(TERM, _lower(t or "")))
    out = []
    for i, terms in wanted.items():
        scores = []
        for doc, c in found:
            m = 100 - 90 + (90 * c.total() * n_docs) // total if total else 0
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t]), doc))
        out += [(i, k + 1, None if doc == LAST else doc, -s) for k, (s, doc) in enumerate(sorted(x for x in scores if x[0])[:top])]
    return out


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


#: The same in DuckDB, by joining the terms of items with those of all documents.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) nd, sum(n)::BIGINT l FROM n),
m AS (SELECT doc_id, 100 - 90 + (90 * n * nd) // l m FROM n, s),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT w FROM tf, s GROUP BY t, nd),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES = {"op11_search": (op11_search, ORACLE_SQL)}
