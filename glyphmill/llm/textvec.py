"""Word and n-gram hashing of whole Arrow string columns at once, without a Python object a row.

A word is a maximal run of bytes other than ASCII white space. Hashes are polynomials modulo 2^64
with an odd base over random byte (or word) codes, taken from prefix sums, then mixed; they depend
on the content alone, so that equal spans hash alike in any partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 2 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER = CODES.copy()
LOWER[65:91] = CODES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, U)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Hasher:
    """Hashes of spans of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        self.inverse = powers(pow(base, -1, 1 << 64), len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * powers(base, len(codes)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


@dataclass
class Words:
    """The words of the texts in a chunk: byte ranges, each text's first word and number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, codes: np.ndarray = CODES) -> np.ndarray:
        """Of each word."""
        return Hasher(codes[self.data]).of(self.starts, self.ends)

    def stripped(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' starts and ends without up to three bytes of these kinds at the end and one at the start, unless nothing else is there."""
        s, e = self.starts.copy(), self.ends.copy()
        for _ in range(3):
            e -= kinds[self.data[e - 1]] & (e - s > 1)
        s += kinds[self.data[s]] & (e - s > 1)
        return s, e

    @property
    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def last(self) -> np.ndarray:
        return self.first + self.count


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches together with their texts' bytes, about ``size`` bytes at a time or one text."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = ~SPACE) -> Words:
    """Maximal runs of bytes of one kind within a text; bytes of kind 0 are between words."""
    if not len(data):
        none, zero = np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        return Words(data, none, none, zero, zero)
    kind = kinds[data]
    begins, stops = kind != 0, kind != 0
    change = kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    change[edges - 1] = True
    begins[1:] &= change
    stops[:-1] &= change
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    cut = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, cut[:-1], np.diff(cut))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte, and in all."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return before


def slide(a: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """op over each ``width`` neighbours: n - width + 1 values."""
    size, r = 1, a
    while 2 * size <= width:
        r = op(r[:-size], r[size:])
        size *= 2
    if size < width:
        r = op(r[: len(r) - (width - size)], r[width - size :])
    return r


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that hold every group of neighbours with the same key whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. (count numbers) of each, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
