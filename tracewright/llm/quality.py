"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded: shares of byte
classes, statistics of its words and hashed words go through a learned layer. A gated attention network weighs the
passages, and the weighted sum is scored. Only the document's label trains all of it.

The model is fitted on whole documents, every passage of them: at most ``SAMPLE`` labelled ones, taken by the hash of
their id while their passages are at most ``SAMPLE * BAG`` together. Scoring runs in the tasks with the broadcast weights
(a few thousand numbers, whatever the input).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._session import arrow_rows, cut

SAMPLE, BAG, PASSAGE, BUCKETS, HIDDEN, GATE, STEPS, SEED = 4000, 50, 64, 16, 24, 12, 600, 7
SPACES = A.word_table(lower_ascii_words=False)
#: What SPACES cuts words into.
WORD = r"[^\x20\x09-\x0D]+"


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, continued, other non-ASCII, space, line end, . , and the marks one by one or together."""
    out = np.full(256, 15, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:192], out[192:] = 0, 1, 2, 3, 4
    for k, marks in enumerate((" \t", "\n\r", ".", ",", "!?", "#$%&*", "|", "()[]{}<>", "=_/\\", ";:'\"-")):
        out[[ord(c) for c in marks]] = 5 + k
    return out


CLASSES = _classes()
FEATURES = 16 + 8 + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each row (one more entry than rows); a row has one at least."""
    starts, ends, first = A.word_bounds(data, offsets, SPACES)
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    bag = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(words)), words)
    of_word = bag[row] + (np.arange(len(starts)) - first[row]) // PASSAGE
    n = int(bag[-1])
    size = np.maximum(1, np.bincount(of_word, minlength=n)).astype(np.float32)
    x = np.zeros((n, FEATURES), np.float32)
    if not len(starts):
        x[:, 24:] = -1 / BUCKETS
        return x, bag
    opens = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
    begin, stop = starts[opens], ends[np.append(opens[1:], len(starts)) - 1]
    full = of_word[opens]
    place = np.repeat(full, stop - begin)
    counts = np.bincount(place * 16 + CLASSES[data[A.spread(begin, stop - begin)]], minlength=n * 16).reshape(n, 16)
    x[:, :16] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    length = (ends - starts).astype(np.float32)
    h = A.word_hashes(data, starts, ends)
    inner = np.append(False, of_word[1:] == of_word[:-1])
    again = inner & np.append(False, h[1:] == h[:-1])
    order = np.lexsort((h, of_word))
    twice = np.append(False, (h[order][1:] == h[order][:-1]) & (of_word[order][1:] == of_word[order][:-1]))
    upper, last_mark = CLASSES[data[starts]] == 1, CLASSES[data[ends - 1]]
    tail_upper = upper & ((length == 1) | (CLASSES[data[np.minimum(starts + 1, len(data) - 1)]] == 1))
    mean = np.bincount(of_word, length, n) / size
    stats = (mean / 10, np.sqrt(np.bincount(of_word, (length - mean[of_word]) ** 2, n) / size) / 10, np.bincount(of_word, again, n) / size, np.bincount(of_word[order], twice, n) / size, np.bincount(of_word, upper, n) / size, np.bincount(of_word, tail_upper, n) / size, np.bincount(of_word, last_mark > 8, n) / size, np.log1p(np.bincount(of_word, minlength=n)) / 4)
    for k, s in enumerate(stats):
        x[:, 16 + k] = s
    hashed = np.bincount(of_word * BUCKETS + (h >> np.uint64(60)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    x[:, 24:] = hashed / size[:, None] - 1 / BUCKETS
    return x, bag


def forward(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    """All layers over the passages of whole bags; ``score`` is by bag, ``weight`` the attention of each passage."""
    z = (x - w["mean"]) / w["scale"]
    h = np.tanh(z @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    logit = (t * s) @ w["a"]
    start, count = bag[:-1], np.diff(bag)
    top = np.repeat(np.maximum.reduceat(logit, start), count)
    raised = np.exp(logit - top)
    weight = raised / np.repeat(np.add.reduceat(raised, start), count)
    pooled = np.add.reduceat(weight[:, None] * h, start)
    score = 1 / (1 + np.exp(-np.clip(pooled @ w["o"] + w["b"], -30, 30)))
    return {"z": z, "h": h, "t": t, "s": s, "weight": weight, "pooled": pooled, "score": score}


def gradients(w: dict[str, np.ndarray], f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    count = np.diff(bag)
    d = (f["score"] - y) / len(y)
    pooled = d[:, None] * w["o"]
    each = np.repeat(pooled, count, axis=0)
    inner = (each * f["h"]).sum(1)
    logit = f["weight"] * (inner - np.repeat(np.add.reduceat(f["weight"] * inner, bag[:-1]), count))
    ts = logit[:, None] * w["a"]
    dv, du = ts * f["s"] * (1 - f["t"] ** 2), ts * f["t"] * f["s"] * (1 - f["s"])
    dh = (each * f["weight"][:, None] + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    g = {"o": f["pooled"].T @ d, "b": d.sum(), "a": (f["t"] * f["s"]).T @ logit, "V": f["h"].T @ dv, "U": f["h"].T @ du, "E": f["z"].T @ dh, "e": dh.sum(0)}
    return {k: v + (decay * w[k] if k in "oVUE" else 0) for k, v in g.items()}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, steps: int = STEPS, batch: int = 256, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights by Adam over batches of bags; without labels of both kinds a model that always gives their share."""
    rng = np.random.default_rng(seed)
    w = {"mean": x.mean(0) if len(x) else np.zeros(FEATURES), "scale": (x.std(0) if len(x) else np.zeros(FEATURES)) + 0.02, "E": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.3, HIDDEN), "b": np.array(0.0)}
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.5
        return w | {"o": np.zeros(HIDDEN), "b": np.array(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))}
    m = {k: np.zeros_like(v) for k, v in w.items() if k not in ("mean", "scale")}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    for step in range(1, steps + 1):
        take = rng.choice(len(y), min(batch, len(y)), replace=False)
        lengths = np.diff(bag)[take]
        part, sub = x[A.spread(bag[take], lengths)], np.append(0, np.cumsum(lengths))
        g = gradients(w, forward(w, part, sub), sub, y[take], 1e-4)
        for k in m:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - 0.01 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, most: int = BAG) -> dict[str, np.ndarray]:
    """Weights from labelled documents that are not held out: at most ``sample``, of ``most`` passages each on average.

    Labels that are null or of ids without document are passed over; of an id with several labels each counts; repeated
    rows count once. Documents are taken by the hash of their id, each with all its passages; one whose passages are
    more than what is left of ``sample * most`` is passed over for the next.
    """
    arrow_rows(docs.sparkSession)
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    joined = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "doc_id")
    joined = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label", F.xxhash64("text").alias("h"))
    count = F.greatest(F.lit(1), F.ceil(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) / PASSAGE))
    joined = cut(joined.dropDuplicates(["doc_id", "label", "h"]).withColumn("n", count))
    left, chosen = sample * most, []
    for r in joined.select("doc_id", "label", "h", "n").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "h").limit(sample).collect():
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id, r.label, r.h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            x, bag = passages(*A.text_bytes(batch.column(1)))
            raw = [x[a:b].tobytes() for a, b in zip(bag[:-1].tolist(), bag[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(raw, pa.binary())], names=["doc_id", "label", "h", "x"])

    taken = docs.sparkSession.createDataFrame(chosen, "doc_id string, label int, h long")
    fitted = joined.drop("n").join(F.broadcast(taken), ["doc_id", "label", "h"]).select("doc_id", "text", "label", "h").mapInArrow(run, "doc_id string, label int, h long, x binary")
    rows = [(r.doc_id, r.label, r.x) for r in sorted(fitted.collect(), key=lambda r: (r.doc_id, r.label, r.h))]
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    return fit(x, np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64), np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, weights: dict[str, np.ndarray], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), score and passage (the one of most weight, from 0) of each document.

    A null or empty text has one passage without words. Repeated rows are scored each; other columns are not read.
    """
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in weights.items()})
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            x, bag = passages(*A.text_bytes(batch.column(1)))
            f = forward(shared.value, x, bag)
            best = np.array([int(np.argmax(f["weight"][a:b])) for a, b in zip(bag[:-1].tolist(), bag[1:].tolist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f["score"].astype(np.float64)), pa.array(best)], names=["doc_id", "h", "score", "passage"])

    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h")).mapInArrow(run, f"doc_id {kind}, h long, score double, passage int")


def accepted(docs: DataFrame, weights: dict[str, np.ndarray], *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores at least that much; decided row by row, in one pass."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in weights.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, text):
            at = batch.schema.get_field_index(text)
            f = forward(shared.value, *passages(*A.text_bytes(batch.column(at))))
            yield batch.filter(pa.array(f["score"] >= least))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole of documents by a model of labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_quality": (op2_quality, None)}
