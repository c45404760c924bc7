"""Exact removal of repeated byte strings with suffix arrays.

Every ``length``-byte window is named after its anchor (``_passages``), so equal windows of any two documents, or of
one, meet in one shard. A shard's distinct stretches are joined by separators and their suffix array is induced:
suffixes are classified, leftmost-smaller substrings sorted and named, their order induced on all others. Permuted
common prefixes then tell which windows have an equal neighbour. Stretches that are the same throughout are counted
before and sorted once; where an anchor has too many different ones for a shard, their windows get longer anchors.
Text is dealt by document id twice, to cut out the stretches and to remove what was found.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _passages as P
from tracewright.llm._suffix import common_prefixes, suffix_array

LENGTH, K, SHARD_BYTES = 400, 64, 1 << 19


def repeated_windows(parts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, ranges of starts of windows that start elsewhere in the parts too; byte 255 is in no UTF-8 text."""
    sizes = np.array([len(x) for x in parts], np.int64)
    data = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    letters = data.astype(np.uint16) + np.uint16(2)
    letters[first + sizes] = 1
    letters = np.append(letters, np.uint16(0))
    order = suffix_array(letters)
    lcp = common_prefixes(np.append(data, np.uint8(255)), order, first, 4 * length)
    rest = np.append(np.repeat(first + sizes, sizes + 1), 0) - np.arange(len(letters))
    alike = lcp[order] >= length
    same = np.zeros(len(letters), bool)
    same[order] = alike | np.append(alike[1:], False)
    same &= rest >= length
    return [P.ranges(same[a : a + n]) for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def repeated_bytes(docs: DataFrame, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, h, start, n: ranges of bytes of ``_passages.keyed`` documents that a repeated window covers."""
    found = P.candidates(P.stretches(docs, words=False, length=length, k=k), other_ids=False)

    def shard(table: pa.Table) -> tuple:
        each = repeated_windows(table.column("content").to_pylist(), length)
        a, n = (np.concatenate(x) for x in zip(*each, strict=True))
        return np.repeat(np.arange(len(each)), [len(x) for x, _ in each]), a, n, np.zeros(len(a), np.int64)

    marks = P.marked(docs, found, F.lit(0), shard, words=False, length=length, ks=P.grams(length, k), most=SHARD_BYTES)
    return found.select("doc_id", "h", "start", "anchor", "body").join(marks, ["anchor", "body"]).select("doc_id", "h", (F.col("start") + F.col("a")).alias("start"), (F.col("m") + (length - 1)).alias("n"))


def remove_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (array of byte ranges removed), kept (binary).

    A null text is empty; texts shorter than ``length`` bytes keep all. Repeated rows of one id and text are each
    other's repetition, with an id or without. Other columns are not read.
    """
    base = P.keyed(docs, doc_id, text)

    def digest(data: np.ndarray, _a: None, _b: None, gone: np.ndarray) -> tuple:
        a, n = P.ranges(gone)
        return len(data), int(n.sum()), len(a), [{"start": int(x), "end": int(x + y)} for x, y in zip(a, n, strict=True)], (data[~gone] if len(a) else data).tobytes()

    return P.removed(base, repeated_bytes(base, length=length, k=k), digest, words=False, schema="n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary", types=[pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of ``remove_repeated_bytes`` over the whole of documents."""
    found = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """The digest by looking at every window of every text; for small fixtures."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


#: The same in DuckDB, by the hash of every window.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) b FROM documents), s AS (SELECT *, octet_length(b) n FROM d),
win AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) g FROM (SELECT doc_id, b, unnest(range(1, n - 398)) i FROM s WHERE n >= 400)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM win SEMI JOIN again USING (g)),
run AS (SELECT doc_id, i, count(*) FILTER (p IS NULL OR i > p + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) r FROM hit),
span AS (SELECT doc_id, r, min(i) a, max(i) + 400 z FROM run GROUP BY 1, 2),
gone AS (SELECT doc_id, count(*) n_spans, sum(z - a) n_removed FROM span GROUP BY 1),
rest AS (SELECT doc_id, a, z FROM (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) a, a z FROM span UNION ALL SELECT doc_id, max(z), 1000000000000 FROM span GROUP BY 1)),
kept AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, a, z - 1)), '' ORDER BY a)) k FROM rest JOIN d USING (doc_id) WHERE a < z GROUP BY 1)
SELECT doc_id, n n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, coalesce(n_spans, 0) n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(k, ''::BLOB) END) kept_sha256 FROM s LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op7_suffix_dedup": (op7_suffix_dedup, ORACLE_SQL)}
