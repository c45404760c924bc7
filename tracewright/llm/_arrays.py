"""Vectorised text helpers used inside Spark tasks.

Everything works on the UTF-8 bytes of a slice of rows, in tiles of bounded size, so that memory follows the
slice and not the number of rows of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TILE, PLACE_BITS, LONG_WORD = 1 << 18, 20, 256
_MASK = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes: bytes of a word, words of a window, and a second one to confirm.
BASE_BYTES, BASE_WORDS, BASE_CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_powers: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}


def _tables(base: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Powers of base and of its inverse over one tile, and the factor from a tile to the next."""
    if base not in _powers:
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(TILE, base, np.uint64), np.full(TILE, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down), pow(base, TILE, 1 << 64), pow(inverse, TILE, 1 << 64)
    return _powers[base]


def word_table(*, lower_ascii_words: bool) -> np.ndarray:
    """True for bytes of a word: runs of [0-9a-zA-Z] and non-ASCII, or whatever is no ASCII white space."""
    table = np.ones(256, bool)
    if lower_ascii_words:
        table[:128] = False
        for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x41, 0x5B)):
            table[a:b] = True
    else:
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of texts or binaries and where each row begins; a null row has none."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about that many bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        first, total = 0, 0
        for k, n in enumerate(sizes.to_pylist()):
            if total and total + n > most:
                yield batch.slice(first, k - first)
                first, total = k, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more entry than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Prefix:
    """Polynomial prefix sums over a sequence: the hash of any stretch [a, b) in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, n = base, len(values)
        up, self.down, step, self.step = _tables(base)
        self.sums = np.zeros(n + 1, np.uint64)
        factor, carry = 1, np.uint64(0)
        with np.errstate(over="ignore"):
            for a in range(0, n, TILE):
                b = min(n, a + TILE)
                part = values[a:b].astype(np.uint64)
                part += np.uint64(1)
                part *= up[: b - a]
                part *= np.uint64(factor)
                np.cumsum(part, out=self.sums[a + 1 : b + 1])
                self.sums[a + 1 : b + 1] += carry
                carry, factor = self.sums[b], factor * step & _MASK
        tiles = np.ones(n // TILE + 2, np.uint64)
        for k in range(1, len(tiles)):
            tiles[k] = int(tiles[k - 1]) * self.step & _MASK
        self.tiles = tiles

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = self.sums[b] - self.sums[a]
            h *= self.down[a % TILE]
            if len(self.tiles) > 2:
                h *= self.tiles[a // TILE]
            return mixed(h)

    def all(self, length: int) -> np.ndarray:
        """The hash of every stretch of that length."""
        n = max(0, len(self.sums) - length)
        a = np.arange(n)
        return self.hashes(a, a + length)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_BYTES) -> np.ndarray:
    """A hash of each word; the sums are kept for a tile of bytes at a time.

    Some long words agree under polynomials of every odd base, so that words of over LONG_WORD bytes are hashed otherwise.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        a = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, a + 8 * TILE, side="right")))
        prefix = Prefix(data[a : int(ends[last - 1])], base)
        out[first:last] = prefix.hashes(starts[first:last] - a, ends[first:last] - a)
        first = last
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[int(starts[k]) : int(ends[k])].tobytes(), base)
    return out


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of that many values, where its smallest stands; of equal ones the first.

    Values are compared by all but their lowest PLACE_BITS bits, where places stand meanwhile. Long arrays are taken in parts,
    so that it is the same bits whatever surrounds a window.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if width == 1:
        return np.arange(n)
    step = (1 << PLACE_BITS) - width
    if step <= 0:
        raise ValueError(f"windows of {width} values are too long")
    return np.concatenate([_first_min(values[a : a + step + width - 1], width) + a for a in range(0, n, step)])


def _first_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, np.uint64(_MASK))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index in the ordered array of each value, -1 where it has none."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == values, at, -1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True where one of the stretches lies, over n places."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0
