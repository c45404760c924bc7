"""Suffix arrays by induced sorting and their permuted common prefixes, over arrays of small numbers."""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last place counts as smaller."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(t[:-1] < t[1:], True)
    return smaller[nearest]


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray, *, small: bool = False) -> np.ndarray:
    """Splits groups of equal rank by a key; a rank is the place where its group begins. What is still tied.

    Small keys go into one number with the rank, which sorts faster than two.
    """
    if small:
        order = np.argsort(rank[active] << 32 | key + 1)
    else:
        order = np.lexsort((key, rank[active])) if rank.any() else np.argsort(key)
    active, key, old = active[order], key[order], rank[active[order]]
    place = np.arange(len(active))
    opens = np.append(True, old[1:] != old[:-1])
    fresh = opens.copy()
    fresh[1:] |= key[1:] != key[:-1]
    base = np.maximum.accumulate(np.where(opens, place, 0))
    start = np.maximum.accumulate(np.where(fresh, place, 0))
    rank[active] = old + (start - base)
    alone = fresh & np.append(fresh[1:], True)
    return active[~alone]


def lms_order(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The leftmost-smaller suffixes in order: their substrings get names, ties are broken over the string of names."""
    m, width, bits = len(lms), 6, 10
    pad = (1 << bits) - 1
    end = np.append(lms[1:], lms[-1])
    rank, active, r = np.zeros(m, np.int64), np.arange(m), 0
    while len(active):
        key = np.zeros(len(active), np.uint64)
        for j in range(width):
            p = lms[active] + r * width + j
            inside = p <= end[active]
            key = (key << np.uint64(bits)) | np.where(inside, t[np.minimum(p, len(t) - 1)], pad).astype(np.uint64)
        active = _refine(rank, active, key)
        r += 1
        active = active[end[active] - lms[active] + 1 >= r * width]
    # equal substrings share a name: the reduced string, whose suffixes are sorted by doubling what is compared
    active, step = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1), 1
    while len(active):
        key = np.where(active + step < m, rank[np.minimum(active + step, m - 1)], -1)
        active = _refine(rank, active, key, small=True)
        step *= 2
    out = np.empty(m, lms.dtype)
    out[rank] = lms
    return out


def _deal(parts: list[list[np.ndarray]], p: np.ndarray, c: np.ndarray) -> None:
    if not len(p):
        return
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for x, at in zip(np.split(p, cuts), np.append(0, cuts), strict=True):
        parts[int(c[at])].append(x)


def _chain(t: np.ndarray, parts: list[np.ndarray], c: int) -> np.ndarray:
    """The bucket's entries and, after them, those before them that begin with the same letter, again and again."""
    source = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out = [source]
    while len(source):
        source = source[source > 0] - 1
        source = source[t[source] == c]
        out.append(source)
    return np.concatenate(out)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t, whose last letter is 0 and occurs nowhere else; letters are below 1000."""
    t = t.astype(np.uint16)
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(t) == 1:
        return np.zeros(1, np.int64)
    seeds = lms_order(t, lms)
    letters = int(t.max()) + 1
    by_letter: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(by_letter, seeds, t[seeds])
    seed = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in by_letter]
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    left: list[np.ndarray] = []
    for c in range(letters):
        full = _chain(t, larger[c], c)
        left.append(full)
        both = np.concatenate([full, seed[c]])
        p = both[both > 0] - 1
        p = p[t[p] > c]
        _deal(larger, p, t[p])
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    smaller[0].append(np.array([len(t) - 1]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * letters
    for c in reversed(range(letters)):
        full = _chain(t, smaller[c], c)
        out[c] = np.concatenate([left[c], full[::-1]])
        both = np.concatenate([full, left[c][::-1]])
        p = both[both > 0] - 1
        p = p[t[p] < c]
        _deal(smaller, p, t[p])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, forced: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: what its suffix shares with the one before it in order, up to most.

    Only irreducible places are compared; each other place has one less than the place before it. Forced places are
    compared as well.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here, there = np.arange(1, n), before[1:]
    irreducible = np.ones(n, bool)
    irreducible[1:] = (there < 1) | (data[here - 1] != data[np.maximum(there, 1) - 1])
    irreducible[forced] = True
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    eight = np.ndarray((n + most + 8,), "<u8", padded.tobytes(), strides=(1,))
    at = np.flatnonzero(irreducible & (before >= 0))
    to, done = before[at], 0
    while len(at) and done < most:
        x = eight[at + done] ^ eight[to + done]
        off = x != 0
        y = x[off]
        bit = np.log2((y & (~y + np.uint64(1))).astype(np.float64)).astype(np.int64)
        lcp[at[off]] = done + bit // 8
        at, to, done = at[~off], to[~off], done + 8
    lcp[at] = most
    source = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return np.maximum(lcp[source] - (np.arange(n) - source), 0)
