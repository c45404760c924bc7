"""Base spans against Python's own regular expressions, bootstrapped ones on planted contexts."""

import hashlib
import random
import re

from tracewright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(c // 10 + c % 10 for c in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base(text):
    out = []
    for rank, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def texts():
    rng = random.Random(7)
    out = [None, "", " ", "a@b.c_d@e.f", "x@y.z.", "+1+1+12345678901", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.00.1", "4111 1111 1111 1111", "4111-1111-1111-1111x", "0.0.0.0", "1.2.3.00", "000.1.1.1", "é@é.é é1@b.co", "+1 (555) 555-0100.", "😀 a@b.co 😀 10.0.0.1"]
    out += ["".join(rng.choice("a.@-+1290 ()_%é\n") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(rng.choice("0123456789 -+.") for _ in range(40)) for _ in range(200)]
    out += ["4" * 60_000, "a" * 3_000, "a." * 2_000 + "@", "ab@" + "c." * 50_000, "10.0.0.1 " * 3000, "日本" * 50_000, "1 " * 40_000]
    return out


def test_long_runs_take_no_time_in_their_square(spark):
    long = ["a" * 400_000, "a." * 200_000 + "@", "x1" * 200_000]  # Python's plain patterns would take minutes
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert [len(r.base) for r in pii.find(docs).collect()] == [0, 0, 0]


def test_base_spans_and_counts(spark):
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts())], "doc_id long, text string, h int, base string").repartition(4)
    found = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base) for r in pii.find(docs).collect()}
    assert found == {i: base(t) for i, t in enumerate(texts())}


def test_query_on_test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.op1_pii(spark, sf).collect()}
    for r in rows:
        want = base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[r.doc_id].n_ip == want.count("ip:") and got[r.doc_id].n_email == want.count("email:")


def test_patterns_discover_identifiers_that_the_base_misses(spark):
    rng = random.Random(3)
    rows = [(i, f"word {rng.choice('abc')} my phone: +1 555 {rng.randint(1000000, 9999999)} end") for i in range(40)]
    rows += [(50, "again my phone: 5551234567 end"), (51, "we saw 5551234567 of them"), (52, "order no. 1234567890"), (53, "same phone: 0800123456")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == [("phone", 16, 26)] and got[53] == [("phone", 12, 22)]
    assert got[51] == got[52] == [] and all(len(got[i]) == 1 for i in range(40))


def test_redact_keeps_other_columns_and_takes_overlaps(spark):
    rows = [(1, "mail a@b.co or +1 555 555 0100, bye", 3), (2, None, 4), (3, "clean", 5), (3, "clean", 5), (None, "10.0.0.1", 6), (4, "+4111 1111 1111 1111", 7)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    assert out.columns == ["doc_id", "text", "spans"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(1, "mail [EMAIL] or [PHONE], bye", 3), (2, None, 4), (3, "clean", 5), (3, "clean", 5), (None, "[IP]", 6), (4, "+[CARD]", 7)]


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_matches_in_one_text(spark):
    """80,000 addresses: places are right to the last, and replaced texts too; twice as many take about twice as long."""
    from time import monotonic

    took = []
    for n in (40_000, 80_000):
        docs = spark.createDataFrame([(1, "10.0.0.1 " * n)], "doc_id long, text string")
        start = monotonic()
        (row,) = pii.find(docs).collect()
        took.append(monotonic() - start)
        assert [(s.start, s.end) for s in row.base] == [(9 * k, 9 * k + 8) for k in range(n)]
    assert took[1] < 3 * took[0] + 2
    assert pii.redact(docs).first().text == "[IP] " * 80_000


def test_replaced_texts_by_a_loop(spark):
    """Spans that overlap, over several chunks and behind wide characters."""
    rows = [(k, ("😀 é a@b.co +4111 1111 1111 1111, 10.0.0.1x" * n) + "end") for k, n in enumerate((1, 100, 700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for r in pii.redact(docs).collect():
        out, at, text = [], 0, rows[r.doc_id][1]
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:]


def test_confident_patterns_by_loops(spark):
    """Scores of the pattern-instance graph, turn by turn, one edge after the other."""
    rng = random.Random(5)
    shapes = {"phone": re.compile(r"^[^a-zA-Z0-9]*(?:[0-9][^a-zA-Z0-9]*){7,15}$"), "ip": re.compile(r"^[0-9]+(?:[^0-9a-zA-Z]+[0-9]+){3}$")}
    edges = {}
    for _ in range(600):
        number, seed = rng.randint(0, 60), rng.random() < 0.6
        kind = "phone" if number % 2 else "ip"
        instance = f"555 000 {number:04d}" if kind == "phone" else f"10.0.{number}.1"
        pattern = rng.choice(["call", "tel", "my tel"] if kind == "phone" else ["host", "at"]) if rng.random() < 0.9 else rng.choice(["of", "call", "host"])
        key = pattern, instance, kind if seed and number < 40 else None
        edges[key] = edges.get(key, 0) + 1
    frame = spark.createDataFrame([(*k, n) for k, n in edges.items()], "pattern string, instance string, kind string, n long")
    got = {r.pattern: (r.kind, round(r.confidence, 9)) for r in pii.confident(frame, turns=3, support=2, confidence=0.7).collect()}

    import math

    links, total = {}, {}
    for (p, i, _), n in edges.items():
        links[p, i] = links.get((p, i), 0) + n
        total[p] = total.get(p, 0) + n
    seeds = {(i, k): 1.0 for _, i, k in edges if k}
    scores = dict(seeds)
    for _ in range(3):
        hit, distinct = {}, {}
        for (p, i), n in links.items():
            for (j, k), score in scores.items():
                if i == j:
                    hit[p, k] = hit.get((p, k), 0) + n * score
                    distinct[p, k] = distinct.get((p, k), 0) + (score > 0.5)
        good = {(p, k): h / total[p] * distinct[p, k] / (distinct[p, k] + 1) for (p, k), h in hit.items() if distinct[p, k] >= 2}
        good = {x: c for x, c in good.items() if c >= 0.7 * 2 / 3}
        miss = {}
        for (p, i), _n in links.items():
            for (q, k), c in good.items():
                if p == q and shapes[k].match(i):
                    miss[i, k] = miss.get((i, k), 0) + math.log(1 - min(c, 0.999))
        scores = dict(seeds)
        for x, m in miss.items():
            scores[x] = max(scores.get(x, 0), 1 - math.exp(m))
    want = {}
    for (p, k), c in good.items():
        want[p] = max(want.get(p, (0, "")), (c, k))
    assert got == {p: (k, round(c, 9)) for p, (c, k) in want.items()} and len(got) >= 3
