"""Rules over time on streams, with state of their own and event-time timers.

What a rule needs is the rows of a key in order of time. Rows wait, packed by Spark's own aggregation, in slots of a key
until the watermark has passed the slot; then a ``Step`` takes them in order and keeps what the rule has to know of the
past: failures of one window, an open chain, the last scan. Rows of a slot that is over are late and are dropped, as
everywhere on streams. Results equal those of the batch operator over all rows that were not late.

Some incidents can be overtaken by what is still to come. Such streams are changes: ``revision`` counts them for each
key, the greatest one holds, and an ``event_count`` of 0 takes the incident back. ``standing`` reads the result.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, deque
from collections.abc import Iterator
from types import SimpleNamespace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCIDENT = "pattern string, severity string, confidence double, seq long, source_ip string, username string, event_count long, start_us long, end_us long, sources array<string>"
CHANGE = f"{INCIDENT}, revision long"
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Step:
    """What a rule does with the next row of a key; kept is its memory (a tuple), None at the start."""

    #: Schemas of what is kept and given out, and what orders rows of one key.
    kept: str
    out: str

    def order(self, row: Row) -> tuple:
        return (row.us, row.seq)

    def rows(self, key: tuple, kept: tuple | None, released: list[Row]) -> tuple[list[tuple], tuple | None]:
        """Takes rows in order; gives out rows and the new memory."""
        raise NotImplementedError

    def due(self, kept: tuple | None) -> int | None:
        """The time (microseconds) from which on ``closed`` is to be called, whatever comes."""
        return None

    def closed(self, key: tuple, kept: tuple, now_us: int) -> tuple[list[tuple], tuple | None]:
        return [], kept


class Released(StatefulProcessor):
    """Hands the rows of a key to a step, slot by slot once the watermark has passed them."""

    def __init__(self, step: Step, slot_us: int) -> None:
        self.step, self.slot_us, self.columns = step, slot_us, StructType.fromDDL(step.out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.step.kept)

    def _now(self, timer_values: Any) -> int:
        """The time up to which all slots have come: the watermark, down to the begin of its slot."""
        now = timer_values.getCurrentWatermarkInMs() * 1000
        return now - now % self.slot_us

    def _stored(self, key: tuple, before: tuple | None, kept: tuple | None, now: int) -> list[tuple]:
        """Closes what is due, keeps the rest and sets the timer for it: one slot on, when its slot has come."""
        out, due = [], self.step.due(kept)
        if kept is not None and due is not None and due < now:
            out, kept = self.step.closed(key, kept, now)
            due = self.step.due(kept)
        if kept is None:
            if before is not None:
                self.kept.clear()
        elif kept != before:
            self.kept.update(kept)
        if kept is not None and due is not None:
            self.handle.registerTimer((due - due % self.slot_us + self.slot_us) // 1000 + 1)
        return out

    def _run(self, key: Any, released: list[SimpleNamespace], timer_values: Any) -> Iterator[Row]:
        key, out = tuple(key), []
        kept = before = self.kept.get()
        kept = before = tuple(before) if before is not None else None
        if released:
            out, kept = self.step.rows(key, kept, sorted(released, key=self.step.order))
        told = Row(*self.columns)
        for r in [*out, *self._stored(key, before, kept, self._now(timer_values))]:
            yield told(*r)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        return self._run(key, [SimpleNamespace(**r) for slot in rows for r in slot.rows], timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        return self._run(key, [], timerValues)

    def close(self) -> None:
        pass


def _slots(rows: DataFrame, key: list[str], seconds: int, *aggregates: Column) -> DataFrame:
    """Rows (ts with its watermark) packed by key and slot; given out when the watermark has passed the slot. State is in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(F.window("ts", f"{seconds} seconds").alias("slot"), *key).agg(*aggregates)


def released(rows: DataFrame, key: list[str], step: Step, *, slot_s: int) -> DataFrame:
    """The rows (ts with its watermark, and all that the step reads) through the step, in slots of so many seconds."""
    timed = rows.withColumn("us", F.unix_micros("ts"))
    fields = [c for c in timed.columns if c not in ("ts", *key)]
    packed = _slots(timed, key, slot_s, F.collect_list(F.struct(*fields)).alias("rows"))
    return packed.groupBy(*key).transformWithState(Released(step, slot_s * 1_000_000), step.out, "append", "eventTime")


class HandedOn(StatefulProcessor):
    """Adds to a slot of a key how many rows were before it, and the time of the last one. Rows pass through as one text a slot.

    Slots of a batch come in any order: their texts wait in state, so that no more than one is in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept, self.texts = handle.getValueState("kept", "last bigint, nth bigint"), handle.getMapState("texts", "first bigint", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        slots = []
        for r in rows:
            slots.append((r.first, r.last, r.n))
            self.texts.updateValue((r.first,), (r.rows,))
        kept = self.kept.get()
        before, nth = tuple(kept) if kept is not None else (None, 0)
        for first, last, n in sorted(slots):
            yield Row(key=key[0], before=before, nth=nth, rows=self.texts.getValue((first,))[0])
            self.texts.removeKey((first,))
            before, nth = last, nth + n
        self.kept.update((before, nth))

    def close(self) -> None:
        pass


def neighbours(rows: DataFrame, *, order: list[str], slot_s: int) -> DataFrame:
    """Rows (key, ts with its watermark, row, and what else orders them) with us, before (time of the row before) and nth.

    Inside slots Spark orders them; of the past a slot needs a count and one time. Columns: key, us, before, nth, row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), *order, "row")))
    text = F.to_json(F.transform(ordered, lambda r: F.struct(r["us"].alias("us"), r["row"].alias("row"))))
    us = F.unix_micros("ts")
    packed = _slots(rows, ["key"], slot_s, text.alias("rows"), F.min(us).alias("first"), F.max(us).alias("last"), F.count("*").alias("n"))
    told = packed.groupBy("key").transformWithState(HandedOn(), "key string, before bigint, nth bigint, rows string", "append", "eventTime")
    back = told.withColumn("rows", F.from_json("rows", "array<struct<us: bigint, row: string>>"))
    zipped = F.arrays_zip(F.col("rows.us").alias("us"), F.concat(F.array("before"), F.col("rows.us")).alias("before"), F.col("rows.row").alias("row"))
    each = back.select("key", "nth", F.posexplode(zipped).alias("i", "r")).where("r.us is not null")
    return each.select("key", "r.us", "r.before", (F.col("nth") + F.col("i") + 1).alias("nth"), "r.row")


def only(kinds: tuple[str, ...]) -> Column:
    """Rows of these types. The condition also reads the time, so it stays above the watermark, which every row moves."""
    return F.when(F.col("ts").isNotNull(), F.col("event_type").isin(*kinds))


def _typed(events: DataFrame, kinds: tuple[str, ...], late: str) -> DataFrame:
    known = events.withColumn("source_ip", F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown")))
    return known.select("ts", "seq", "source", "event_type", "source_ip", "username").withWatermark("ts", late).where(only(kinds))


class AfterFailures(Step):
    """The first login, by seq, of an address after ``least`` failures, or failures of so many users, within the window.

    Kept are the failures of one window, the seq that was told and how often one was told.
    """

    kept = "failures array<struct<us: bigint, username: string, source: string>>, told bigint, revision bigint"
    out = CHANGE

    def __init__(self, pattern: str, window_us: int, least: int, *, users: bool, base: float, step: float, most: float) -> None:
        self.pattern, self.window_us, self.least, self.users, self.confidence = pattern, window_us, least, users, (base, step, most)

    def order(self, row: Row) -> tuple:
        return (row.us, row.event_type == "auth_success", row.seq)

    def rows(self, key: tuple, kept: tuple | None, released: list[Row]) -> tuple[list[tuple], tuple | None]:
        failures, told, revision = (deque(map(tuple, kept[0])), kept[1], kept[2]) if kept else (deque(), None, 0)
        users = Counter(f[1] for f in failures if f[1])
        base, step, most = self.confidence
        out = []
        for r in released:
            while failures and failures[0][0] < r.us - self.window_us:
                _, user, _ = failures.popleft()
                if user:
                    users[user] -= 1
                    if not users[user]:
                        del users[user]
            if r.event_type == "auth_fail":
                failures.append((r.us, r.username, r.source))
                if r.username:
                    users[r.username] += 1
                continue
            n = len(users) if self.users else len(failures)
            if n >= self.least and (told is None or r.seq < told):
                told, revision = r.seq, revision + 1
                sources = sorted({x for x in (*(f[2] for f in failures), r.source) if x is not None})
                out.append((self.pattern, "CRITICAL", round(min(most, base + step * n), 6), r.seq, key[0], r.username, n + 1, failures[0][0], r.us, sources, revision))
        return out, ([*failures], told, revision) if failures or told is not None else None

    def due(self, kept: tuple | None) -> int | None:
        return kept[0][-1][0] + self.window_us if kept and kept[0] else None

    def closed(self, key: tuple, kept: tuple, now_us: int) -> tuple[list[tuple], tuple | None]:
        """No failure counts any more; an address that was told stays known by one number."""
        return [], ([], kept[1], kept[2]) if kept[1] is not None else None


def brute_then_success(events: DataFrame, *, window_s: int = 600, fails: int = 5, late: str = "10 minutes") -> DataFrame:
    """Changes, by address: the first login after that many failures within the window."""
    step = AfterFailures("BRUTE_THEN_SUCCESS", window_s * 1_000_000, fails, users=False, base=0.6, step=0.01, most=0.95)
    return released(_typed(events, ("auth_fail", "auth_success"), late), ["source_ip"], step, slot_s=window_s)


def spray_then_pivot(events: DataFrame, *, window_s: int = 600, users: int = 5, late: str = "10 minutes") -> DataFrame:
    """Changes, by address: the first login after failures of that many users within the window."""
    step = AfterFailures("SPRAY_THEN_PIVOT", window_s * 1_000_000, users, users=True, base=0.5, step=0.02, most=0.9)
    return released(_typed(events, ("auth_fail", "auth_success"), late), ["source_ip"], step, slot_s=window_s)


def _related(pattern: str, severity: str, confidence: float, head: tuple, related: list[tuple]) -> tuple:
    """An incident of a head (seq, us, source, source_ip, username) and what follows it (seq, us, source)."""
    sources = sorted({x for x in (head[2], *(r[2] for r in related)) if x is not None})
    return (pattern, severity, confidence, head[0], head[3], head[4], len(related) + 1, head[1], max([head[1], *(r[1] for r in related)]), sources)


class LastScan(Step):
    """The scan of an address that came in last, and the exploits that came in first of those within the window after it."""

    kept = "seq bigint, us bigint, source string, username string, related array<struct<seq: bigint, us: bigint, source: string>>, revision bigint"
    out = CHANGE

    def __init__(self, window_us: int, most: int) -> None:
        self.window_us, self.most = window_us, most

    def order(self, row: Row) -> tuple:
        return (row.us, row.event_type == "exploit", row.seq)

    def rows(self, key: tuple, kept: tuple | None, released: list[Row]) -> tuple[list[tuple], tuple | None]:
        scan, related, revision = (tuple(kept[:4]), [tuple(r) for r in kept[4]], kept[5]) if kept else (None, [], 0)
        out = []
        tell = lambda: out.append((*_related("RECON_THEN_EXPLOIT", "CRITICAL", 0.85, (*scan[:3], key[0], scan[3]), related), revision))
        for r in released:
            if r.event_type == "net_scan":
                if scan is None or r.seq > scan[0]:
                    if related:
                        revision += 1
                        tell()
                        out[-1] = (*out[-1][:6], 0, *out[-1][7:])
                    scan, related = (r.seq, r.us, r.source, r.username), []
            elif scan is not None and r.us <= scan[1] + self.window_us:
                first = sorted([*related, (r.seq, r.us, r.source)], key=lambda x: x[:2])[: self.most]
                if first != related:
                    related, revision = first, revision + 1
                    tell()
        return out, (*scan, related, revision) if scan else None


def recon_then_exploit(events: DataFrame, *, window_s: int = 600, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """Changes, by address: the last scan and the exploits after it; a newer scan takes back what was told of an older one.

    An address that scanned is remembered by that scan; no exploit is kept that came before it.
    """
    return released(_typed(events, ("net_scan", "exploit"), late), ["source_ip"], LastScan(window_s * 1_000_000, most), slot_s=window_s)


PERSISTED = "array<struct<seq: bigint, us: bigint, source: string, source_ip: string, username: string, related: array<struct<seq: bigint, us: bigint, source: string>>>>"


def _least(found: list[tuple], row: tuple, most: int) -> None:
    """Keeps the least ``most`` rows, in order; a repeated row is one."""
    if (len(found) < most or row < found[-1]) and row not in found:
        insort(found, row)
        del found[most:]


def first_following(rows: list[tuple], begin_us: int, window_us: int, most: int) -> list[tuple]:
    """Of the rows (us, later, seq, ...) of two slots: heads of the first one, and the first ``most`` by seq that follow each within the window.

    What follows a head is the rest of its slot, read backwards, and the beginning of the next one: two running minima.
    """
    rest: list[tuple] = []
    heads, after = [], []
    for r in sorted(rows, key=lambda r: (r[0], r[1]), reverse=True):
        if r[1]:
            if r[0] < begin_us + window_us:
                _least(rest, (r[2], r[0], r[3] is not None, r[3] or ""), most)
            else:
                after.append(r)
        elif r[0] < begin_us + window_us:
            heads.append((r, [*rest]))
    following: list[tuple] = []
    out = []
    for head, own in reversed(heads):
        while after and after[-1][0] <= head[0] + window_us:
            r = after.pop()
            _least(following, (r[2], r[0], r[3] is not None, r[3] or ""), most)
        both = sorted({*own, *following})[:most]
        if both:
            out.append((head, both))
    return out


def _follow(window_us: int, most: int):
    """``first_following`` for packed pairs of slots."""

    @F.arrow_udf(PERSISTED)
    def follow(begin: pa.Array, packed: pa.Array) -> pa.Array:
        names = ("us", "later", "seq", "source", "source_ip", "username")
        kind = pa.list_(pa.struct([("seq", pa.int64()), ("us", pa.int64()), ("source", pa.string()), ("source_ip", pa.string()), ("username", pa.string()), ("related", pa.list_(pa.struct([("seq", pa.int64()), ("us", pa.int64()), ("source", pa.string())])))]))
        ends, out = packed.offsets.to_pylist(), []
        for k, at in enumerate(begin.to_pylist()):
            part = packed.values.slice(ends[k], ends[k + 1] - ends[k])
            rows = list(zip(*(part.field(n).to_pylist() for n in names), strict=True))
            found = first_following(rows, at, window_us, most)
            out.append([{"seq": h[2], "us": h[0], "source": h[3], "source_ip": h[4], "username": h[5], "related": [{"seq": r[0], "us": r[1], "source": r[3] if r[2] else None} for r in related]} for h, related in found])
        return pa.array(out, kind)

    return follow


def persistence(events: DataFrame, *, window_s: int = 600, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """Each login that new users or autostarts of the same user or address follow within the window; told when it is over.

    Rows of a user or address meet in pairs of slots of one window's length and never as pairs of rows; an aggregation by
    login keeps the first of both. A pair of slots is over when the watermark has passed it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = events.select("ts", "seq", "source", "event_type", "source_ip", "username").withWatermark("ts", late).where(only(("auth_success", "user_add", "persistence")))
    keys = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("key")) for c in ("username", "source_ip")))).alias("k")
    row = F.struct(F.unix_micros("ts").alias("us"), (F.col("event_type") != "auth_success").alias("later"), "seq", "source", "source_ip", "username")
    keyed = known.select("ts", keys, row.alias("row")).where(F.col("k.key") != "")
    packed = keyed.groupBy(F.window("ts", f"{2 * window_s} seconds", f"{window_s} seconds").alias("slots"), "k.of", "k.key").agg(F.collect_list("row").alias("rows"))
    both = F.exists("rows", lambda r: r["later"]) & F.exists("rows", lambda r: ~r["later"])
    found = packed.where(both).select("slots", F.explode(_follow(window_s * 1_000_000, most)(F.unix_micros("slots.start"), F.col("rows"))).alias("h"))
    heads = found.groupBy("slots", "h.seq", "h.us", "h.source", "h.source_ip", "h.username").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.related")))), 1, most).alias("related"))
    return heads.select(
        F.lit("PERSISTENCE").alias("pattern"), F.lit("HIGH").alias("severity"), F.lit(0.75).alias("confidence"), "seq", "source_ip", "username",
        (F.size("related") + 1).cast("long").alias("event_count"), F.col("us").alias("start_us"), F.greatest("us", F.array_max("related.us")).alias("end_us"),
        F.array_sort(F.array_distinct(F.filter(F.concat(F.array("source"), F.col("related.source")), lambda x: x.isNotNull()))).alias("sources"),
    )


class Chain(Step):
    """Hops of an address to another host each, no more than the window apart; told when nothing can follow."""

    kept = "host string, last bigint, n bigint, hosts array<string>, users array<string>, start bigint"
    out = "source_ip string, pattern string, severity string, confidence double, hop_count long, target_hosts array<string>, usernames array<string>, start_us long, end_us long"

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def rows(self, key: tuple, kept: tuple | None, released: list[Row]) -> tuple[list[tuple], tuple | None]:
        out = []
        for r in released:
            if kept is None or kept[0] != r.target_host:
                if kept is not None and kept[2] and r.us - kept[1] > self.window_us:
                    more, kept = self.closed(key, kept, r.us)
                    out += more
                n, hosts, users, start = (kept[2], list(kept[3]), list(kept[4]), kept[5]) if kept and kept[2] else (0, [], [], r.us)
                hosts += [r.target_host] * (r.target_host not in hosts)
                users += [r.username] * (r.username not in users)
                kept = (r.target_host, r.us, n + 1, hosts, users, start)
        return out, kept

    def due(self, kept: tuple | None) -> int | None:
        return kept[1] + self.window_us if kept and kept[2] else None

    def closed(self, key: tuple, kept: tuple, now_us: int) -> tuple[list[tuple], tuple | None]:
        """The chain, if it has two hops; of the address its last host stays known, to tell the next hop from it."""
        host, last, n, hosts, users, start = kept
        base, long = min(0.9, 0.4 + 0.1 * n), n >= 3
        told = (key[0], "MULTI_HOP_CHAIN" if long else "SEQUENTIAL_HOP", "CRITICAL" if long else "HIGH", round(min(0.95, base + 0.1) if long else base, 6), n, list(hosts), sorted(users), start, last)
        return [told] * (n >= 2), (host, last, 0, [], [], 0)


def sequential(hops: DataFrame, *, window_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Chains of at least two hops. hops: ts, seq, source_ip, target_host, username; a hop without time is in no stream's order."""
    rows = hops.select("ts", "seq", "source_ip", "target_host", "username").withWatermark("ts", late).where(F.col("ts").isNotNull())
    return released(rows, ["source_ip"], Chain(window_s * 1_000_000), slot_s=window_s)


def gaps(events: DataFrame, *, threshold_s: float = 300, key: str = "case_id", late: str = "10 minutes", slot_s: int = 3600) -> DataFrame:
    """Silences longer than the threshold between neighbours of one key, told when the slot of the event that ends them is over."""
    rows = events.select("ts", F.col(key).alias("key"), F.lit("").alias("row")).withWatermark("ts", late).where(F.col("ts").isNotNull())
    silence = F.col("us") - F.col("before")
    near = neighbours(rows, order=[], slot_s=slot_s).where(silence > round(threshold_s * 1_000_000))
    return near.select(F.col("key").alias(key), F.timestamp_micros("before").alias("start"), F.timestamp_micros("us").alias("end"), (silence / 1e6).alias("duration_s"))


def interleaved(events: DataFrame, *, threshold_min: float = 30, key: str = "case_id", late: str = "10 minutes", slot_s: int = 3600) -> DataFrame:
    """Events and gap rows of each key, with pos; the columns are those of the batch operator."""
    own = [f for f in events.schema if f.name not in ("start", "end", "duration_min", "entry_type", "pos")]
    rows = events.select("ts", F.col(key).alias("key"), "source", "action", F.to_json(F.struct(*(f.name for f in own)), MICROS).alias("row"))
    placed = neighbours(rows.withWatermark("ts", late).where(F.col("ts").isNotNull()), order=["source", "action"], slot_s=slot_s)
    silence = (F.col("us") - F.col("before")) / 1e6 / 60
    event = F.struct(F.lit("event").alias("entry_type"), (2 * F.col("nth")).alias("pos"), F.lit(None).cast("double").alias("duration_min"), "row")
    gap = F.struct(F.lit("gap").alias("entry_type"), (2 * F.col("nth") - 1).alias("pos"), F.round(silence, 1).alias("duration_min"), F.lit(None).cast("string").alias("row"))
    told = placed.select("key", "us", "before", F.explode(F.when(silence > threshold_min, F.array(gap, event)).otherwise(F.array(event))).alias("e"))
    back = F.from_json("e.row", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own), MICROS)
    cells = [F.col("key").alias(key) if f.name == key else back[f.name].alias(f.name) for f in own]
    is_gap = F.col("e.entry_type") == "gap"
    return told.select(*cells, F.when(is_gap, F.timestamp_micros("before")).alias("start"), F.when(is_gap, F.timestamp_micros("us")).alias("end"), "e.entry_type", "e.pos", "e.duration_min")


def deduplicated(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """The last row, by seq, of each time in seconds, source, action, actor and target; told when the watermark has passed it.

    Windows of one second hold the key's time, so the state of a key expires with its second. Built-in aggregation only.
    """
    rest = [c for c in events.columns if c not in ("source", "actor", "target")]
    rows = events.withWatermark("ts", late).where(F.col("ts").isNotNull()).withColumn("action_key", F.lower(F.trim("action")))
    one = rows.groupBy(F.window("ts", "1 second").alias("second"), "source", "action_key", "actor", "target").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return one.select(F.col("second.start").alias("second"), "source", "action_key", "actor", "target", "r.*")


def write_changes(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the stream into Parquet, a folder a batch: a batch that is run again after a failure replaces its folder."""

    def batch(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={k}")

    return rows.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def standing(changes: DataFrame, *key: str) -> DataFrame:
    """What holds of changes: the row of greatest revision of each key (the address by default), if it was not taken back."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*(key or ("source_ip",))).orderBy(F.desc("revision"))))
    return last.where((F.col("_n") == 1) & (F.col("event_count") > 0)).drop("_n", "revision")
