"""Vectorised text helpers for tasks that work on Arrow batches.

A batch's texts lie end to end in one byte buffer, so words, hashes and shingles of all texts
come from a few numpy passes over that buffer instead of a Python loop over words.  Slices are
bounded in bytes (one longer text makes a slice of its own), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: all but ASCII white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of digits, letters and anything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (a public finaliser: shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > 8 * SLICE_BYTES:
            return tables
        _powers[:] = tables
    return _powers


class Texts:
    """Texts of one slice: bytes end to end, and where each text begins; null counts as empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spans(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes of a kind, and where each text's runs begin."""
        inside = kind[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = self.bounds[:-1][self.bounds[:-1] < len(inside)]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = self.bounds[1:-1]
        after[ends[ends > 0] - 1] = False
        stops = np.flatnonzero(inside & ~after) + 1
        return starts, stops, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like spans, for the pieces between newlines: a text with k newlines has k + 1 lines."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        order = np.argsort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        owner = np.concatenate([np.arange(len(self)), np.searchsorted(self.bounds, breaks, side="right") - 1])[order]
        by_text = np.argsort(owner, kind="stable")
        starts, owner = starts[by_text], owner[by_text]
        first = np.searchsorted(owner, np.arange(len(self) + 1))
        stops = np.empty_like(starts)
        stops[:-1] = starts[1:] - 1
        last = first[1:] - 1
        stops[last] = self.bounds[1:]
        return starts, stops, first

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit hash of each span, equal for equal bytes wherever they stand."""
        power, inverse = _power_tables(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, dtype=np.uint64)
        total[0] = 0
        parts = _BYTE[self.data]
        parts *= power[: len(self.data)]
        np.cumsum(parts, out=total[1:])
        return mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[tuple[int, Texts]]:
    """The texts of a string column in slices of bounded bytes, with the row each slice begins at."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        part = data[offsets[row] : offsets[end]]
        yield row, Texts(LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row])
        row = end


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = (total + words[k : len(words) - width + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(33)
    return mix(total + np.uint64(width))


def shingle_sets(texts: Texts, kind: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; with fewer words, the whole sequence as one."""
    starts, stops, first = texts.spans(kind)
    words = texts.hashes(starts, stops)
    joined = sequence_hashes(words, width)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            yield sequence_hashes(words[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhashes(items: np.ndarray, seeds: np.ndarray, block: int = 2048) -> np.ndarray:
    """Smallest scrambled value of a set under each seed (all ones for an empty set)."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(items), block):
        part = (items[k : k + block, None] ^ seeds[None, :]) * np.uint64(0x9FB21C651E98DF25)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def minwise(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, half: bool = False, raw: bool = False) -> np.ndarray:
    """Minwise values of many runs of scrambled hashes (of one item at least), one row a run.

    They have the type of the seeds: uint32, or uint16, which takes half the time and suits runs of a few thousand
    items (more make equal values of unlike runs likely).  With half, only items of even hash count, so near-equal
    sets still agree; a run's first item stands in where none would be left.  With raw, items are scrambled here.
    """
    kind = seeds.dtype.type
    shift, factor = np.uint64(64 - 8 * seeds.dtype.itemsize), kind(0x9E3779B1 & np.iinfo(kind).max)
    least = np.empty((len(starts), len(seeds)), dtype=kind)
    row = 0
    while row < len(starts):  # blocks that stay in the processor's cache
        ends = np.cumsum(sizes[row : row + 512])
        count = min(max(1, int(np.searchsorted(ends, 1 << 16, side="right"))), len(ends))
        part = np.concatenate([hashes[a : a + n] for a, n in zip(starts[row : row + count], sizes[row : row + count], strict=True)])
        part = mix(part) if raw else part
        bounds = ends[:count] - sizes[row : row + count]
        if half:
            even = (part & np.uint64(1)) == 0
            even[bounds] = True
            part, bounds = part[even], np.concatenate([[0], np.cumsum(even)])[bounds]
        values = (part >> shift).astype(kind)
        turned = np.empty_like(values)
        for k, seed in enumerate(seeds):
            np.bitwise_xor(values, seed, out=turned)
            np.multiply(turned, factor, out=turned)
            least[row : row + count, k] = np.minimum.reduceat(turned, bounds)
        row += count
    return least


def seeds(count: int, salt: int = 1) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array a row."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
