"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four base patterns. The words left of a span are its lexical pattern. Patterns and instances
(the lower-cased text of a span or of an unexplained token that looks like an identifier) form a graph that is scored
in turns: a pattern is as good as the instances it meets, an instance as good as the patterns that introduce it.
Tokens that a pattern of high confidence introduces become spans too. Base spans always stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._session import cut

#: Kinds in the order of the digest, with their pattern. Possessive forms and look-behinds only save
#: time: each has the leftmost matches of the plain form, without repeated starts inside one run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))(?:\.|$)){4}$"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SHAPES = {"email": r"^[^@]++@[^@]++$", "ip": r"^[0-9]++(?:[^0-9a-zA-Z]++[0-9]++){3}$", "card": r"^[^a-zA-Z0-9]*+(?:[0-9][^a-zA-Z0-9]*+){12,}+$", "phone": r"^[^a-zA-Z0-9]*+(?:[0-9][^a-zA-Z0-9]*+){7,15}+$"}
CHUNK, CELL, CONTEXT, TURNS, SUPPORT, CONFIDENCE = 256, 64, 60, 3, 3, 0.8


def in_chunks(items: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], run: Callable[[Column, Column], Column], kind: str) -> Column:
    """``run`` (a chunk of the items, what the chunks before come to) of all chunks, one array after the other.

    Every chunk is totalled once and hands its total on. What is bound by a one-element transform is not repeated.
    """
    last = lambda z: F.floor((F.size(z) - 1) / F.lit(CHUNK)).cast("int")
    part = lambda z, c: F.transform(F.array(F.slice(z, c * CHUNK + 1, F.lit(CHUNK))), lambda p: F.struct(p.alias("part"), total(p).cast("long").alias("n")))[0]
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def before(parts: Column) -> Column:
        return F.aggregate(parts, begin, lambda a, x: F.struct(join(a["at"], x["n"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), last(z)), lambda c: part(z, c))
        return F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, before(p), lambda x, at: run(x["part"], at))))[0]

    return F.transform(F.array(items), lambda z: F.when(F.size(z) == 0, F.array().cast(kind)).otherwise(whole(z)))[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text, left) of the leftmost matches; places count code points, left is the text before.

    The text is split at the matches, and the lengths of the parts are summed chunk by chunk.
    """
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(parts, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("text"), F.right(p, F.lit(CONTEXT)).alias("left")))
    kind = "array<struct<start:bigint,end:bigint,text:string,left:string>>"

    def add(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["left"].alias("left")))).alias("out"))

    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["size"])
    run = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda a: a["out"])
    return in_chunks(F.slice(zipped, 1, F.size(found)), total, lambda a, n: a + n, run, kind)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """True if a string of digits has a Luhn check digit."""
    each = F.transform(F.filter(F.split(F.reverse(c), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.floor(x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end, kind, text, left) of all kinds; of a null text none."""
    return F.array_sort(F.concat(*(spans_of(F.coalesce(text, F.lit("")), rank, kind) for rank, kind in enumerate(KINDS))))


def spans_of(text: Column, rank: int, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["text"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["text"].alias("text"), m["left"].alias("left")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string,left:string>>")
    return F.when(text.contains(MARKS[kind]) if MARKS[kind] else text.rlike("[0-9]"), spans).otherwise(none)


def tokens(text: Column) -> Column:
    """Array of (start, end, text, left) of tokens that hold a digit or @, without punctuation at their ends."""
    text = F.coalesce(text, F.lit(""))
    found = F.transform(matches(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), F.regexp_extract(m["text"], r"^[^0-9A-Za-z+@]*+", 0).alias("head"), m["text"].alias("raw"), m["left"].alias("left")))
    found = F.transform(found, lambda m: F.struct((m["start"] + F.length(m["head"])).alias("start"), F.regexp_extract(F.substr(m["raw"], F.length(m["head"]) + 1), r"^.*[0-9A-Za-z]", 0).alias("text"), m["left"].alias("left")))
    none = F.array().cast("array<struct<start:bigint,text:string,left:string>>")
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda m: F.length(m["text"]) >= 6)).otherwise(none)


def patterns(left: Column) -> Column:
    """The last word and the last two words before a span, lower-cased; digits are alike."""
    clean = F.regexp_replace(F.lower(left), "[0-9]", "0")
    one = F.regexp_extract(clean, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(clean, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    return F.filter(F.array(one, two), lambda p: p != "")


def shaped(text: Column, kind: Column) -> Column:
    out = F.lit(False)
    for k, shape in SHAPES.items():
        out = F.when(kind == k, text.rlike(shape)).otherwise(out)
    return out


def confident(edges: DataFrame, *, turns: int = TURNS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind and confidence of the patterns that hold up, from edges (pattern, instance, kind or null, n).

    A pattern's confidence is the share of its occurrences that score as instances of a kind, less one in support + 1
    for few distinct ones; an instance that is no seed scores 1 - the product of 1 - confidence over its patterns.
    """
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    links = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    seeds = edges.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    scores = seeds
    for turn in range(turns):
        met = links.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.sum(F.when(F.col("score") > 0.5, 1).otherwise(0)).alias("kinds"))
        good = met.join(total, "pattern").select("pattern", "kind", "kinds", (F.col("hit") / F.col("total") * F.col("kinds") / (F.col("kinds") + 1)).alias("confidence"))
        good = cut(good.where((F.col("kinds") >= support) & (F.col("confidence") >= confidence * support / (support + 1))))
        if turn + 1 < turns:
            reached = links.join(good, "pattern").where(shaped(F.col("instance"), F.col("kind"))).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
            scores = seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    return good.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))


def _celled(spans: DataFrame) -> DataFrame:
    """Each span once for every stretch of CELL places that it touches."""
    return spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / F.lit(CELL)), F.floor((F.col("end") - 1) / F.lit(CELL)))))


def unexplained(rows: DataFrame) -> DataFrame:
    """row, start, end, instance and left of the tokens that no base span overlaps, by a join on stretches of places."""
    token = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("s")).select("row", "s.start", (F.col("s.start") + F.length("s.text")).alias("end"), F.lower("s.text").alias("instance"), "s.left")
    t, b = _celled(token.select("row", "start", "end")).alias("t"), _celled(rows.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.end")).alias("b")
    meet = (F.col("t.row") == F.col("b.row")) & (F.col("t.cell") == F.col("b.cell")) & (F.col("b.start") < F.col("t.end")) & (F.col("t.start") < F.col("b.end"))
    known = t.join(b, meet, "left_semi").select("row", "start").distinct()
    return token.join(known, ["row", "start"], "left_anti")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", turns: int = TURNS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per document: doc_id, h (hash of the text), base and spans, sorted arrays of (start, rank, end, kind).

    Places count code points, ends are exclusive. A null or empty text has no spans; repeated rows are answered each;
    an empty table gives an empty result. Other columns are not read.
    """
    t = F.col(f"`{text}`")
    rows = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("row"), base_spans(t).alias("base"), tokens(t).alias("tokens")))
    seeds = rows.select("row", F.explode("base").alias("s")).select(F.explode(patterns(F.col("s.left"))).alias("pattern"), F.lower("s.text").alias("instance"), F.col("s.kind").alias("kind"))
    others = cut(unexplained(rows).withColumn("patterns", patterns(F.col("left"))))
    unknown = others.select(F.explode("patterns").alias("pattern"), "instance", F.lit(None).cast("string").alias("kind"))
    edges = cut(seeds.unionByName(unknown).groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    good = confident(edges, turns=turns, support=support, confidence=confidence)
    met = others.withColumn("pattern", F.explode("patterns")).join(good, "pattern").where(shaped(F.col("instance"), F.col("kind")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = met.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")).groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("new"))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return rows.join(new, "row", "left").select("doc_id", "h", bare.alias("base"), F.array_sort(F.concat(bare, F.coalesce("new", none))).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents again, all columns, with each span replaced by its kind in brackets; overlapping spans by the first's.

    A text without spans, a null one too, stays as it is.
    """
    found = find(docs, doc_id=doc_id, text=text, **options).where(F.size("spans") > 0).groupBy("doc_id", "h").agg(F.first("spans").alias("spans")).alias("f")
    t, kind = F.col(f"d.`{text}`"), "array<string>"
    furthest = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))

    def run(part: Column, at: Column) -> Column:
        """What is left of the stretch of text from ``at`` to the end of the part's spans; it is cut out once."""
        stretch = F.substr(t, (at + 1).cast("int"), F.greatest(F.lit(0), furthest(part) - at).cast("int"))

        def replaced(x: Column) -> Column:
            def add(a: Column, s: Column) -> Column:
                gap = F.substr(x, (a["at"] - at + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
                fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
                return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

            return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda a: a["out"])

        return F.transform(F.array(stretch), replaced)[0]

    spans = F.col("f.spans")
    rest = F.array_join(F.concat(in_chunks(spans, furthest, F.greatest, run, kind), F.array(F.substr(t, (furthest(spans) + 1).cast("int")))), "")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(t) == F.col("f.h"))
    joined = docs.alias("d").join(found.hint("shuffle_hash"), same, "left")
    return joined.select(*(F.when(F.col("f.spans").isNotNull(), rest).otherwise(t).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Digest of ``find`` over the whole of documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter(F.col("base.kind"), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op1_pii": (op1_pii, None)}
