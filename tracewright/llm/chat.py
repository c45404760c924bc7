"""Chat formatting by quotation linking, in DataFrame functions only.

A line's leading ">" marks give its quote level. Runs of lines of one level are passages; they are normalised (lower
case, letters and digits only) and hashed. Quoted passages are joined with the messages' own passages, and a message
replies to the earlier message of its conversation that it quotes at its outermost level. Conversations come out
without quotes, replies under what they reply to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._session import cut, stored

MARKS = r"^(?:[ \t]*>)++"
ATTRIBUTION = r"^(?:on|le|am|el)\b.{0,200}\b(?:wrote|écrit|schrieb|escribió)\s?:\s*$"


def lines_of(text: Column) -> Column:
    """Array of (level, text) of all lines, marks and outer blanks removed."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.trim(F.regexp_replace(x, MARKS, "")).alias("text")))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _exploded(messages: DataFrame) -> DataFrame:
    """row, passage (number), level, text of each passage of each message."""
    marked = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["text"].alias("text"), i.alias("i")))
    # a run begins where the level differs from the line before, or after a blank line: lines are compared with
    # themselves moved by one, and runs are the stretches between beginnings
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("text"), F.lit(-1).alias("i"))), F.slice(marked, F.lit(1), F.size("lines") - 1))
    edges = F.filter(F.zip_with(marked, before, lambda x, y: F.when((x["level"] != y["level"]) | ((y["text"] == "") & (x["text"] != "")), x["i"])), lambda i: i.isNotNull())
    cutted = messages.withColumn("edges", edges)
    spans = F.zip_with("edges", F.concat(F.slice("edges", F.lit(2), F.size("edges")), F.array(F.size("lines"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.transform(F.filter(spans, lambda s: s["b"].isNotNull()), lambda s: F.struct(F.get("lines", s["a"])["level"].alias("level"), F.trim(F.array_join(F.transform(F.slice("lines", s["a"] + 1, s["b"] - s["a"]), lambda x: x["text"]), "\n")).alias("text")))
    return cutted.select("row", F.posexplode(F.filter(runs, lambda r: r["text"] != "")).alias("passage", "p")).select("row", "passage", "p.level", "p.text")


def _with_parent(quoted: DataFrame, own: DataFrame, *, part: int = 1024) -> DataFrame:
    """Quoted passages with the latest earlier turn of their conversation that has the passage as its own (parent).

    Turns are looked up inside parts of a conversation, and parts only hand on their last turn, so that a passage that
    comes again and again in one conversation is not one task.
    """
    keys = ["hash", "conv_id", "part"]
    placed = lambda df: df.where("conv_id is not null and turn is not null").withColumn("part", F.floor(F.col("turn") / part))
    both = placed(quoted).withColumn("has", F.lit(None).cast(dict(own.dtypes)["turn"])).unionByName(placed(own).select("hash", "conv_id", "part", "turn", F.col("turn").alias("has")), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max("has").over(earlier)).where("row is not null")
    last = placed(own).groupBy(*keys).agg(F.max("turn").alias("last")).unionByName(placed(quoted).select(*keys).distinct(), allowMissingColumns=True).groupBy(*keys).agg(F.max("last").alias("last"))
    before = last.withColumn("far", F.max("last").over(Window.partitionBy("hash", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    found = inside.join(stored(before.where("far is not null")), keys, "left").withColumn("parent", F.coalesce("near", "far"))
    none = quoted.where("conv_id is null or turn is null").withColumn("parent", F.lit(None).cast(dict(own.dtypes)["turn"]))
    return found.select(*quoted.columns, "parent").unionByName(none)


def link(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, text (without quotes), n_quotes, n_found, parent_turn, source_conv, source_turn, path.

    n_quotes counts quoted passages, n_found those that some other message has as its own. parent_turn is the latest
    earlier turn of the conversation that has the outermost quoted passage; source_conv and source_turn the first
    message anywhere that has it. ``path`` (array of turns) orders a conversation: a reply stands under its parent.

    A null text is an empty message without quotes. Quotes of nothing known are removed all the same. Passages that
    many messages share are summed up by hash before they are joined. Turns are numbers. Repeated rows of one turn are each a message;
    a message without conversation or turn has no parent. Other columns are not read.
    """
    kept = cut(conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), lines_of(F.col(f"`{text}`")).alias("lines"), F.monotonically_increasing_id().alias("row")))
    own_lines = F.filter("lines", lambda x: x["level"] == 0)
    attribution = lambda x: x["text"].rlike(f"(?iu){ATTRIBUTION}")
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    clean = F.array_join(F.transform(F.filter(own_lines, lambda x: ~(quoted & attribution(x))), lambda x: x["text"]), "\n")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, "\n{3,}", "\n\n"), "^\n+|\n+$", ""))
    found = cut(_exploded(kept).select("row", "passage", "level", F.xxhash64(normal("text")).alias("hash"), F.length(normal("text")).alias("size")).where("size > 0"))
    where = found.join(kept.select("row", "conv_id", "turn"), "row")
    own, quoted = where.where("level = 0"), where.where("level > 0")
    # one row a hash, written before it is joined, so that Spark can split the quotes of a passage that many messages quote
    anywhere = stored(own.join(stored(quoted.select("hash").distinct()), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("conv_id", "turn", "row")).alias("source")))
    quotes = _with_parent(quoted, own).join(anywhere, "hash", "left")
    quotes = quotes.select("row", "level", "passage", F.when(F.col("source.row") != F.col("row"), F.col("source")).alias("source"), "parent")
    told = quotes.groupBy("row").agg(
        F.count("*").alias("n_quotes"), F.count(F.coalesce(F.col("parent").cast("string"), F.col("source.row").cast("string"))).alias("n_found"),
        F.min(F.when(F.col("parent").isNotNull(), F.struct("level", "passage", "parent"))).alias("up"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "passage", "source"))).alias("out"),
    )
    full = kept.select("row", "conv_id", "turn", "role", clean.alias("text")).join(told, "row", "left")
    out = full.select("conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("up.parent").alias("parent_turn"), F.col("out.source.conv_id").alias("source_conv"), F.col("out.source.turn").alias("source_turn"))
    return ordered(cut(out))


def ordered(messages: DataFrame) -> DataFrame:
    """Adds ``path``; each turn doubles the ancestors known, so that turns grow with the logarithm of the depth.

    A message stands under its own parent. A turn of several rows is, to those that reply to it, where its row of latest
    parent stands. Messages without a parent are not joined.
    """
    links = messages.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")).withColumn("path", F.array("turn"))
    while links.where("up is not null").limit(1).count():
        higher = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        joined = links.join(higher, ["conv_id", "up"], "left")
        top = F.when(F.col("up").isNull(), F.col("path")).when(F.col("above").isNull(), F.concat(F.array("up"), "path")).otherwise(F.concat("above", "path"))
        links = cut(joined.select("conv_id", "turn", F.when(F.col("above").isNotNull(), F.col("next")).alias("up"), top.alias("path")))
    above = links.select("conv_id", F.col("turn").alias("parent_turn"), F.col("path").alias("above"))
    replies = messages.where("parent_turn is not null").join(above, ["conv_id", "parent_turn"], "left")
    replies = replies.select(*messages.columns, F.concat(F.coalesce("above", F.array("parent_turn")), F.array("turn")).alias("path"))
    return replies.unionByName(messages.where("parent_turn is null").withColumn("path", F.array("turn")))


def place(path: Column) -> Column:
    """A text that sorts like the path: sixteen digits a turn, the lowest turn all zeros."""
    return F.array_join(F.transform(path, lambda t: F.lpad(F.hex(t.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), "/")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """``link`` over the whole of conversations; the path as text, and place, which sorts a conversation in reply order."""
    found = link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.withColumn("place", place(F.col("path"))).withColumn("path", F.array_join(F.transform("path", lambda t: t.cast("string")), "/"))


QUERIES = {"op9_chat": (op9_chat, None)}
