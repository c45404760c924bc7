"""Grouping spelling variants by composing finite-state machines.

The vocabulary as a minimised acceptor, composed with the transducer of one insertion, deletion or replacement and with
the acceptor again, accepts just the pairs of words one edit apart. The composed machine is enumerated in partitions of
its initial states. While a prefix is shared and no edit is used, the machine stands in a pair of equal states, so words
that share a prefix of ``depth`` letters are one partition: their own acceptor, small enough for a task, is composed and
its pairs are read off. Where the edit falls into the first ``depth`` letters, what remains of both words has to be read
alike, so these arcs leave the partitions: prefix, and what is left after the edit, name the composed state, and words
that reach it meet there, no more than the alphabet has letters. ``depth`` grows until every partition holds
at most ``most`` words, so a common beginning of words is dealt out further and never is one task.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows, stored

RUN, LETTERS, LEAST, EVERY, TIMES, MOST = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97, 2, 5_000
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
GAP = "*"  # stands in no word


def typed(doc: str, runs: Counter) -> Iterator[tuple[str, int]]:
    """The words of one document with a letter deleted where the hash of document and run says so."""
    seed = zlib.crc32(f"{doc}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """word and n of all words of that many letters and occurrences. A null text has none, a null id is as an empty one.

    Tasks add up what they have read before anything is exchanged.
    """
    arrow_rows(docs.sparkSession)
    pattern = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def told() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())], ["word", "n"])
            known.clear()
            return batch

        for batch in A.slices(batches, "text"):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    for word, n in typed(doc or "", Counter(pattern.findall(value.lower() if value.isascii() else value.translate(LOWER)))):
                        if len(word) >= letters:
                            known[word] += n
            if len(known) > 1 << 16:
                yield told()
        yield told()

    narrow = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def acceptor(words: list[str]) -> tuple[list[bool], list[dict[str, int]]]:
    """The minimal deterministic acceptor of sorted distinct words: final states and arcs, the start last.

    States are frozen from their ends on, so arcs always lead to a state of a lower number.
    """
    known: dict[tuple, int] = {}
    final, arcs = [], []
    path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
    letters: list[str] = []

    def freeze() -> int:
        node = path.pop()
        key = (node[0], tuple(node[1]))
        state = known.get(key)
        if state is None:
            state = known[key] = len(final)
            final.append(node[0])
            arcs.append(dict(node[1]))
        return state

    for word in words:
        same = 0
        for a, b in zip(letters, word, strict=False):
            if a != b:
                break
            same += 1
        while len(path) > same + 1:
            state = freeze()
            path[-1][1].append((letters[len(path) - 1], state))
        path.extend((False, []) for _ in range(len(word) - same))
        path[-1] = (True, path[-1][1])
        letters = list(word)
    while len(path) > 1:
        state = freeze()
        path[-1][1].append((letters[len(path) - 1], state))
    final.append(path[0][0])
    arcs.append(dict(path[0][1]))
    return final, arcs


def one_edit(words: list[str]) -> list[tuple[int, int]]:
    """Pairs of numbers of sorted distinct words that the acceptor composed with one edit and itself accepts, each once.

    A word's number is the sum of what its arcs skip. Composed states are visited once, however many prefixes lead there.
    """
    final, arcs = acceptor(words)
    counts: list[int] = []
    skip: list[dict[str, int]] = []
    for f, out in zip(final, arcs, strict=True):
        total, before = int(f), {}
        for letter, to in out.items():
            before[letter] = total
            total += counts[to]
        counts.append(total)
        skip.append(before)
    alike: dict[tuple[int, int], list[tuple[int, int]]] = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 2 * max((len(w) for w in words), default=0)))

    def after(u: int, v: int, without: str = "") -> list[tuple[int, int]]:
        """Numbers within u and v of what both accept from here on, the edit being used; not what begins with a letter."""
        if u == v and not without:
            return [(k, k) for k in range(counts[u])]
        found = None if without else alike.get((u, v))
        if found is None:
            found = [(0, 0)] if final[u] and final[v] else []
            left, right = arcs[u], arcs[v]
            for letter in left if len(left) <= len(right) else right:
                if letter in left and letter in right and letter != without:
                    a, b = skip[u][letter], skip[v][letter]
                    found += [(x + a, y + b) for x, y in after(left[letter], right[letter])]
            if not without:
                alike[u, v] = found
        return found

    near: list[list[tuple[int, int]]] = []
    for p, out in enumerate(arcs):
        pairs, some, before = [], list(out.items()), skip[p]
        for k, (letter, to) in enumerate(some):
            a = before[letter]
            pairs += [(x + a, y + a) for x, y in near[to]]
            pairs += [(x + a, y) for x, y in after(to, p, letter)]
            for other, into in some[k + 1 :]:
                b = before[other]
                pairs += [(x + a, y + b) for x, y in after(to, into)]
        near.append(pairs)
    return near[-1]


def depth_of(words: DataFrame, most: int) -> int:
    """The least number of letters, one at least, by which no more than ``most`` words begin alike."""
    depth = 1
    while (words.groupBy(F.left("word", F.lit(depth)).alias("p")).count().agg(F.max("count")).first()[0] or 0) > most:
        depth += 1
    return depth


def near_pairs(words: DataFrame, *, most: int = MOST, depth: int | None = None) -> DataFrame:
    """a, a_n, b, b_n: all pairs of words of a table (word, n) that are one edit apart, each once. Words are distinct."""
    depth = depth_of(words, most) if depth is None else depth
    schema = "a string, a_n long, b string, b_n long"
    prefix = F.left("word", F.lit(depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
            pairs = one_edit([w[depth:] for w, _ in rows])
            for k in range(0, len(pairs), 1 << 15):
                some = [(*rows[x], *rows[y]) for x, y in pairs[k : k + (1 << 15)]]
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "a_n", "b", "b_n"), r, strict=True)) for r in some], pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())]))

        held: list[tuple[str, int]] = []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and word[:depth] != held[0][0][:depth]:
                    yield from told(held)
                    held = []
                held.append((word, n))
        yield from told(held)

    inside = words.where(F.length("word") >= depth).select("word", "n").repartition(prefix).sortWithinPartitions("word").mapInArrow(run, schema)
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("i")).select("*", F.explode(F.array(F.lit(1), F.lit(0))).alias("read"))
    rest = F.substr("word", F.col("i") + 1 + F.col("read"))
    letter = F.when(F.col("read") == 1, F.substr("word", F.col("i") + 1, F.lit(1))).otherwise("")
    at = at.where(F.col("i") + F.col("read") <= F.length("word")).select(F.concat(F.left("word", F.col("i")), F.lit(GAP), rest).alias("state"), F.struct(letter.alias("letter"), "word", "n").alias("w"))
    met = at.groupBy("state").agg(F.array_sort(F.collect_list("w")).alias("ws")).where(F.size("ws") > 1)
    first = F.substr(F.substring_index("state", GAP, -1), F.lit(1), F.lit(1))
    both = F.filter(F.flatten(F.transform("ws", lambda x: F.transform("ws", lambda y: F.struct(x.alias("x"), y.alias("y"))))), lambda p: (p["x"]["letter"] < p["y"]["letter"]) & ((p["x"]["letter"] != "") | (p["y"]["letter"] != first)))
    early = met.select(F.explode(both).alias("p")).select(F.col("p.x.word").alias("a"), F.col("p.x.n").alias("a_n"), F.col("p.y.word").alias("b"), F.col("p.y.n").alias("b_n"))
    return inside.unionAll(early)


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of a table (word, form): forms followed to the last, which has none.

    Roots go down from form to word, a table a turn; each word is met once. As a form is at least twice as frequent, turns
    are at most the binary logarithm of the greatest count. A word is the form of no more words than it has edits.
    """
    told = forms.where("form is null").select("word", F.col("word").alias("root"))
    rest = forms.where("form is not null").select("word", "form")
    found, front = [told], told
    while True:
        front = stored(rest.join(front.select(F.col("word").alias("form"), "root"), "form").select("word", "root"))
        if front.isEmpty():
            break
        found.append(front)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of documents.

    The form is the near word of largest n, the first by code point among equals, if it is ``times`` as frequent. Repeated
    rows count again; an empty table has no words. Other columns are not read.
    """
    words = stored(vocabulary(docs, doc_id=doc_id, text=text, letters=letters, least=least))
    pairs = near_pairs(words, most=most)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n")))).alias("s"))
    best = sides.groupBy("s.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.n")).alias("m"), F.col("s.near").alias("near"))).alias("best"))
    large = -F.col("best.m") >= times * F.col("n")
    found = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")))
    return found.join(rooted(found), "word").select("word", "n", "n_near", "form", "form_n", "root")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """``variants`` over the whole of documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The rows of ``variants`` by comparing every two words; for small fixtures."""
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall(RUN, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= LETTERS and n >= LEAST}

    def near(x: str, y: str) -> bool:
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    beside = {x: [y for y in words if near(x, y)] for x in words}
    form = {x: min(ys, key=lambda y: (-words[y], y)) if ys else None for x, ys in beside.items()}
    form = {x: y if y is not None and words[y] >= TIMES * words[x] else None for x, y in form.items()}
    out = []
    for x, n in words.items():
        root = x
        while form[root] is not None:
            root = form[root]
        out.append((x, n, len(beside[x]), form[x], words.get(form[x]), root))
    return out


#: The same in DuckDB: words one edit apart have a form with a gap in common; CRC-32 byte by byte.
ORACLE_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(i))),
runs AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) h FROM runs, crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, word[:i] || '*' || word[i + 2:] g, 1 used FROM (SELECT *, unnest(range(length(word))) i FROM words) UNION ALL SELECT word, n, word[:i] || '*' || word[i + 1:], 0 FROM (SELECT *, unnest(range(length(word) + 1)) i FROM words)),
near AS (SELECT DISTINCT a.word, b.word near, b.n FROM gaps a JOIN gaps b ON a.g = b.g AND a.word <> b.word AND a.used + b.used > 0),
best AS (SELECT word, count(*) n_near, min_by({w: near, n: n}, (-n, near)) b FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN b.n >= 2 * w.n THEN b.w END form, CASE WHEN b.n >= 2 * w.n THEN b.n END form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word root FROM f WHERE form IS NULL UNION ALL SELECT f.word, up.root FROM up JOIN f ON f.form = up.word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN up USING (word)
"""

QUERIES = {"op12_spelling": (op12_spelling, ORACLE_SQL)}
