"""Scalar expressions, all of them built-in functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import tables as T


def first_text(*columns: Column) -> Column:
    """The first that is not empty after trimming."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def lookup(column: Column, table: dict, default) -> Column:
    """A value of a small fixed table by key."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column], F.lit(default))


def case_of(column: Column, rules: Iterable[tuple[list[str], str]], default: str) -> Column:
    """The first rule one of whose texts the column contains."""
    out: Column | None = None
    for texts, value in rules:
        hit = F.lit(False)
        for t in texts:
            hit = hit | column.contains(t)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def severity_rank(severity: Column, unknown: int | None = 0) -> Column:
    return lookup(F.lower(F.trim(severity)), T.SEVERITY_RANK, unknown)


def any_time(*columns: Column) -> Column:
    """A timestamp from the first column that holds epoch seconds or an ISO text; without zone it is UTC."""
    forms = []
    for c in columns:
        text = F.trim(c.cast("string"))
        forms += [F.timestamp_seconds(text.try_cast("double")), F.when(~text.rlike(r"^[+-]?[0-9.]+$"), text.try_cast("timestamp"))]
    return F.coalesce(*forms)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.lit(0.0) - F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def clean_address(address: Column) -> Column:
    """Trimmed, without the brackets of an IPv6 literal."""
    return F.regexp_replace(F.trim(address), r"^\[|\]$", "")


def private_v4(address: Column) -> Column:
    second = F.try_element_at(F.split(address, r"\."), F.lit(2)).try_cast("int")
    return F.coalesce(address.startswith("10.") | address.startswith("192.168.") | (address.startswith("172.") & second.between(16, 31)), F.lit(False))


def internal(address: Column) -> Column:
    """Private IPv4, unique-local or link-local IPv6, or a private IPv4 mapped into IPv6."""
    a = F.lower(clean_address(address))
    mapped = F.regexp_extract(a, r"^(?:0*:)*:?ffff:([0-9]+\.[0-9.]+)$", 1)
    return F.coalesce(private_v4(a) | a.rlike(r"^f[cd][0-9a-f]{0,2}:") | a.rlike(r"^fe[89ab][0-9a-f]?:") | private_v4(mapped), F.lit(False))


def is_ip(text: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v6 = r"^(?=[0-9a-fA-F:.%]*:[0-9a-fA-F:.%]*:)[0-9a-fA-F:]+(?:[0-9.]+)?(?:%\w+)?$"
    return F.coalesce(text.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | text.rlike(v6), F.lit(False))


def escape_cef_header(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_cef_extension(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def formula_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def first_match(text: Column, pattern: str, most: int = 200) -> Column:
    return F.substring(F.regexp_extract(text, pattern, 0), 1, most)


def capped(base: float, step: float, n: Column, most: float) -> Column:
    """Confidence that grows with a count up to a cap."""
    return F.least(F.lit(most), F.lit(base) + F.lit(step) * n)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_deleted(path: Column, *, exact: bool = False) -> Column:
    """Without a " (deleted)" mark; by default any of its characters are trimmed, as analysts' tools do."""
    return F.regexp_replace(path, r" \(deleted\)$", "") if exact else F.regexp_replace(path, r"[ (deleted)]+$", "")


def masked(assignment: Column) -> Column:
    """NAME=value with the value masked where the name looks like a secret's."""
    name = F.split_part(assignment, F.lit("="), F.lit(1))
    return F.when(assignment.contains("=") & name.rlike(T.SECRET_NAME), F.concat(name, F.lit("=****[MASKED]"))).otherwise(assignment)


def in_zone(ts: Column, zone: str, raw: Column) -> Column:
    """The time in a zone, ISO with offset; the raw text where there is no time."""
    local = F.from_utc_timestamp(ts, zone)
    minutes = F.round((F.unix_micros(local) - F.unix_micros(ts)) / 60e6).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset), raw)
