"""Thousands of detection rules over events by an index of (field, value), instead of an expression a rule.

Rules are taken apart into maps, the conjunctions of their selections. The index says for each field which maps ask for a
value in it, so a value of an event is looked up once, however many rules there are. What a value satisfies is a set of
bits, one a map; a map holds where all fields' bits meet. Conditions are monotone, so only rules with a map that holds are
looked at. Results are those of ``rules.evaluate``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CACHED, CELLS = 4096, 1 << 22
MATCHES = "array<struct<title: string, level: string>>"


class Index:
    """Compiled rules. Maps are numbered in order of rules; ``needs`` names the fields that any map asks for."""

    def __init__(self, rules: list[dict]) -> None:
        self.rules: list[tuple[str, str]] = []
        self.conditions: list[tuple[list[str], dict[str, list[int]]]] = []
        self.owner: list[int] = []
        self.texts: dict[str, dict[str, list[int]]] = {}  # texts are compared as text
        self.values: dict[str, dict[Any, list[int]]] = {}  # all else by value
        asked: dict[str, set[int]] = {}
        for rule in rules:
            detection = rule.get("detection")
            if not rule.get("title") or not isinstance(detection, dict):
                continue
            named: dict[str, list[int]] = {}
            for name, selection in detection.items():
                if name == "condition" or not isinstance(selection, dict | list):
                    continue
                named[name] = []
                for conjunction in selection if isinstance(selection, list) else [selection]:
                    if isinstance(conjunction, dict):
                        k = len(self.owner)
                        self.owner.append(len(self.rules))
                        named[name].append(k)
                        for field, wanted in conjunction.items():
                            asked.setdefault(field, set()).add(k)
                            if isinstance(wanted, str):
                                self.texts.setdefault(field, {}).setdefault(wanted, []).append(k)
                            else:
                                for value in dict.fromkeys(wanted) if isinstance(wanted, list) else [wanted]:
                                    self.values.setdefault(field, {}).setdefault(value, []).append(k)
            self.rules.append((rule["title"], rule.get("level", "medium")))
            self.conditions.append((str(detection.get("condition", "")).split(), named))
        self.bytes = -(-max(1, len(self.owner)) // 8)
        self.needs = sorted(asked)
        self.free = {f: ~self._bits(asked[f]) for f in self.needs}
        self.cached: OrderedDict[tuple, np.ndarray] = OrderedDict()
        self.judged: OrderedDict[tuple, tuple] = OrderedDict()

    def _bits(self, maps: Any) -> np.ndarray:
        flags = np.zeros(self.bytes * 8, bool)
        flags[list(maps)] = True
        return np.packbits(flags)

    def satisfied(self, field: str, value: Any, text: str | None) -> np.ndarray:
        """The maps that a value of a field leaves standing: those that ask for it and those that ask for nothing there."""
        maps = [*self.values.get(field, {}).get(value, ()), *self.texts.get(field, {}).get("None" if text is None else text, ())]
        if not maps:
            return self.free[field]
        key = (field, type(value), value, text)
        if key not in self.cached:
            self.cached[key] = self.free[field] | self._bits(maps)
            if len(self.cached) > CACHED:
                self.cached.popitem(last=False)
        return self.cached[key]

    def holds(self, rule: int, maps: frozenset[int]) -> bool:
        """The condition of a rule: a chain of and/or from left to right, "1 of name*" or "all of name*"."""
        tokens, named = self.conditions[rule]
        true = lambda name: any(k in maps for k in named.get(name, ()))
        if len(tokens) == 3 and tokens[1].lower() == "of" and tokens[0].lower() in ("1", "all"):
            stem = tokens[2]
            hits = [true(n) for n in named if (n.startswith(stem[:-1]) if stem.endswith("*") else n == stem)]
            return bool(hits) and (any(hits) if tokens[0] == "1" else all(hits))
        out, op = None, None
        for token in tokens:
            if token.lower() in ("and", "or"):
                op = token.lower()
                continue
            now = true(token)
            out = now if out is None else (out and now) if op == "and" else (out or now) if op == "or" else out
        return bool(out)

    def matches(self, maps: tuple[int, ...]) -> tuple[tuple[str, str], ...]:
        """Title and level of the rules that hold where exactly these maps do; what was seen before is remembered."""
        if maps not in self.judged:
            by: dict[int, list[int]] = {}
            for k in maps:
                by.setdefault(self.owner[k], []).append(k)
            self.judged[maps] = tuple(self.rules[r] for r in sorted(by) if self.holds(r, frozenset(by[r])))
            if len(self.judged) > CACHED:
                self.judged.popitem(last=False)
        return self.judged[maps]


def evaluate(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds rule_matches (array of title, level) and flagged, as ``rules.evaluate`` does, for any number of rules.

    The index is sent to the executors once. A field that events lack is null in all of them.
    """
    index = Index(rules)
    there = [f for f in index.needs if f in events.columns]
    always = [f for f in index.needs if f not in events.columns]
    shared = events.sparkSession.sparkContext.broadcast(index)
    own = [c for c in events.columns if c not in ("rule_matches", "flagged")]
    texts = [F.col(f"`{f}`").cast("string").alias(f"_text_{k}") for k, f in enumerate(there)]
    schema = events.select(*(f"`{c}`" for c in own)).schema
    arrow = pa.list_(pa.struct([("title", pa.string()), ("level", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        rest = np.full(at.bytes, 255, np.uint8)
        for f in always:
            rest = rest & at.satisfied(f, None, None)
        step = max(1, CELLS // at.bytes)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                bits = np.repeat(rest[None, :], batch.num_rows, 0)
                for k, f in enumerate(there):
                    pairs = list(zip(batch.column(own.index(f)).to_pylist(), batch.column(len(own) + k).to_pylist(), strict=True))
                    number: dict[Any, int] = {}
                    codes = np.array([number.setdefault(_hashable(p), len(number)) for p in pairs], np.int64)
                    seen = list(dict.fromkeys(map(_hashable, pairs)))
                    bits &= np.stack([at.satisfied(f, v, t) for v, t in seen])[codes]
                matches: list[tuple] = [()] * batch.num_rows
                row, maps = np.nonzero(np.unpackbits(bits, axis=1)[:, : len(at.owner)])
                edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for r in np.flatnonzero(np.diff(edges)).tolist():
                    matches[r] = at.matches(tuple(maps[edges[r] : edges[r + 1]].tolist()))
                column = pa.array([[{"title": t, "level": x} for t, x in m] for m in matches], arrow)
                yield pa.record_batch([*batch.columns[: len(own)], column], [*own, "rule_matches"])

    found = events.select(*(f"`{c}`" for c in own), *texts).mapInArrow(run, StructType([*schema, *StructType.fromDDL(f"rule_matches {MATCHES}")]))
    return found.withColumn("flagged", F.size("rule_matches") > 0)


def _hashable(pair: tuple) -> tuple:
    """Lists and maps are compared by what they print; no rule asks for them by value."""
    value, text = pair
    return (value, text) if value is None or isinstance(value, str | int | float | bool) or getattr(value, "__hash__", None) else (("of", text), text)
