"""Detection rules given as Python records, evaluated as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(selection: dict, columns: list[str]) -> Column:
    """All fields match: a list by membership, a text by text, anything else by value; a missing field is "None"."""
    out = F.lit(True)
    for field, wanted in selection.items():
        actual = F.col(field) if field in columns else F.lit(None).cast("string")
        if isinstance(wanted, list):
            hit = F.coalesce(actual.isin([x for x in wanted if x is not None]), F.lit(False)) | (actual.isNull() & F.lit(None in wanted))
        elif isinstance(wanted, str):
            hit = F.coalesce(actual.cast("string"), F.lit("None")) == wanted
        elif wanted is None:
            hit = actual.isNull()
        else:
            hit = F.coalesce(actual.eqNullSafe(F.lit(wanted)), F.lit(False))
        out = out & hit
    return out


def _selection(selection, columns: list[str]) -> Column:
    maps = selection if isinstance(selection, list) else [selection]
    return reduce(lambda a, b: a | b, (_map(m, columns) for m in maps if isinstance(m, dict)), F.lit(False))


def condition(detection: dict, columns: list[str]) -> Column:
    """One name, a chain of and/or from left to right, "1 of name*" or "all of name*"."""
    named = {k: _selection(v, columns) for k, v in detection.items() if k != "condition" and isinstance(v, dict | list)}
    tokens = str(detection.get("condition", "")).split()
    if not tokens:
        return F.lit(False)
    if len(tokens) == 3 and tokens[1].lower() == "of" and tokens[0].lower() in ("1", "all"):
        stem = tokens[2]
        hits = [c for n, c in named.items() if (n.startswith(stem[:-1]) if stem.endswith("*") else n == stem)]
        join = (lambda a, b: a | b) if tokens[0] == "1" else (lambda a, b: a & b)
        return reduce(join, hits) if hits else F.lit(False)
    out, op = None, None
    for token in tokens:
        if token.lower() in ("and", "or"):
            op = token.lower()
            continue
        now = named.get(token, F.lit(False))
        out = now if out is None else out & now if op == "and" else out | now if op == "or" else out
    return F.lit(False) if out is None else out


def evaluate(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds rule_matches (array of title, level) and flagged; rules without title or detection are passed over."""
    hits = []
    for rule in rules:
        if rule.get("title") and isinstance(rule.get("detection"), dict):
            row = F.struct(F.lit(rule["title"]).alias("title"), F.lit(rule.get("level", "medium")).alias("level"))
            hits.append(F.when(condition(rule["detection"], events.columns), row))
    matches = F.filter(F.array(*hits), lambda m: m.isNotNull()) if hits else F.array().cast("array<struct<title:string,level:string>>")
    return events.withColumn("rule_matches", matches).withColumn("flagged", F.size("rule_matches") > 0)
