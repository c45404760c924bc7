"""Removal of passages that an earlier document has, with suffix automata.

Every window of ``length`` words is named after its anchor (``_passages``); what may be equal meets in one shard. The
distinct stretches of a shard are its reference: a suffix automaton of them keeps, for every state, the smallest
document id that it ends in. All stretches of the shard are streamed through it for their matching statistics, and a
window whose match is at least ``length`` words is removed from every document but the first that has it.

Broadcasting automata of the whole reference has no size bound, so a shard's automaton goes only to the documents
that share an anchor with it; where an anchor has too many different stretches, their windows get longer anchors.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _passages as P

LENGTH, K, SHARD_BYTES = 50, 10, 1 << 19


class Automaton:
    """Suffix automaton of sequences joined by separators that occur once; each sequence has an owner."""

    def __init__(self, sequences: list[list[int]], owners: list[int]):
        self.step, self.link, self.size = [{}], [-1], [0]
        step, link, size = self.step, self.link, self.size
        owner, last = [owners[0]], 0
        for k, (sequence, mine) in enumerate(zip(sequences, owners, strict=True)):
            for c in (*sequence, -1 - k):
                now = len(size)
                step.append({})
                link.append(0)
                size.append(size[last] + 1)
                owner.append(mine)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = now
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    if size[p] + 1 == size[q]:
                        link[now] = q
                    else:
                        copy = len(size)
                        step.append(dict(step[q]))
                        link.append(link[q])
                        size.append(size[p] + 1)
                        owner.append(owner[q])
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = copy
                            p = link[p]
                        link[q] = link[now] = copy
                last = now
        for v in np.argsort(np.array(size), kind="stable")[:0:-1].tolist():
            if owner[v] < owner[link[v]]:
                owner[link[v]] = owner[v]
        self.owner = owner

    def first_owner(self, sequence: list[int], length: int) -> list[int | None]:
        """For each place where a window can start, the smallest owner of a sequence that has the window."""
        step, link, size, owner = self.step, self.link, self.size, self.owner
        out, v, n = [], 0, 0
        for i, c in enumerate(sequence):
            while v and c not in step[v]:
                v = link[v]
                n = size[v]
            if c in step[v]:
                v = step[v][c]
                n += 1
            while size[link[v]] >= length:
                v = link[v]
                n = size[v]
            if i >= length - 1:
                out.append(owner[v] if n >= length else None)
        return out


def earlier_words(docs: DataFrame, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, h, start, n: ranges of words of ``_passages.keyed`` documents that a document of smaller id has."""
    found = P.candidates(P.stretches(docs.where("doc_id is not null"), words=True, length=length, k=k), other_ids=True)

    def shard(table: pa.Table) -> tuple:
        sequences = [np.frombuffer(x, np.uint64).tolist() for x in table.column("content").to_pylist()]
        mine = table.column("extra").to_pylist()
        automaton = Automaton(sequences, mine)
        rows: list[tuple[int, int, int, int]] = []
        for i, sequence in enumerate(sequences):
            owners, a = automaton.first_owner(sequence, length), 0
            for b in range(1, len(owners) + 1):
                if b == len(owners) or owners[b] != owners[a]:
                    if owners[a] is not None and owners[a] < mine[i]:
                        rows.append((i, a, b - a, owners[a]))
                    a = b
        return tuple(np.array(rows, np.int64).reshape(-1, 4).T)

    marks = P.marked(docs, found, F.col("doc_id"), shard, words=True, length=length, ks=P.grams(length, k), most=SHARD_BYTES).withColumnRenamed("extra", "low")
    return found.join(marks, ["anchor", "body"]).where(F.col("low") < F.col("doc_id")).select("doc_id", "h", (F.col("start") + F.col("a")).alias("start"), (F.col("m") + (length - 1)).alias("n"))


def remove_earlier_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Per document: doc_id (a whole number), n_words, n_removed, spans (array of word ranges removed), kept (text).

    A null text has no words; texts of fewer than ``length`` words keep all. Only documents of smaller id count, so
    repeated rows of one id leave each other whole; a row without id neither removes nor loses words. Other columns
    are not read.
    """
    base = P.keyed(docs, doc_id, text)

    def digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
        a, n = P.ranges(gone)
        kept = ~gone
        raw = data[int(starts[0]) : int(ends[-1])].tobytes() if len(starts) else b""
        if len(a):
            shift = int(starts[0])
            raw = b" ".join(raw[x - shift : y - shift] for x, y in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))
        else:
            raw = b" ".join(raw.split())
        return len(gone), int(n.sum()), [{"start": int(x), "end": int(x + y)} for x, y in zip(a, n, strict=True)], raw.decode()

    return P.removed(base, earlier_words(base, length=length, k=k), digest, words=True, schema="n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string", types=[pa.int64()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of ``remove_earlier_words`` over the whole of documents."""
    found = remove_earlier_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]], length: int) -> list[tuple[int, int, int, str]]:
    """The digest by looking at every window of every text; for small fixtures."""
    split = [(i, [w for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]) for i, t in docs]
    low: dict[tuple, int] = {}
    for i, w in split:
        for a in range(len(w) - length + 1):
            g = tuple(w[a : a + length])
            low[g] = min(low.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - length + 1):
            if low[tuple(w[a : a + length])] < i:
                gone |= set(range(a, a + length))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


#: The same in DuckDB, by the hash of every window.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) i FROM dw WHERE len(w) >= 50)),
low AS (SELECT g, min(doc_id) m FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM win JOIN low USING (g) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM dw),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) t, count(*) n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM dw d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op10_substring_dedup": (op10_substring_dedup, ORACLE_SQL)}
