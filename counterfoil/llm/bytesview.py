"""Texts of an Arrow batch as one NumPy byte array, with words and rolling hashes over it.

Hashes are polynomials over the ring of 64-bit integers with an odd base, so a difference of
two prefix sums times a power of the inverse base gives the hash of any slice at once. Lane 0
and lane 1 are independent; together they make a 128-bit fingerprint.

That holds for short slices only: whatever the base, two values that change places in Thue-Morse order at
1,024 even distances leave such a polynomial as it is. Slices of more than `LONG` values are therefore
hashed in blocks, each of which is mixed with its number before they are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
LONG, BLOCK = 320, 256  # up to LONG values at most 256 places lie at even distances, which is far from 1,024
# \x20 and \x09-\x0D: the white space of the word rule.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (one to one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lane:
    """One family of rolling hashes."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
        base = int(draw.integers(1, 2**62)) * 4 + 3
        self.base, self.inverse = U64(base), U64(pow(base, -1, 2**64))
        self._up = self._down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums that `between` reads; values are 64-bit."""
        up, _ = self.powers(len(values))
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair."""
        _, down = self.powers(len(prefix))
        out = mix((prefix[ends] - prefix[starts]) * down[starts])
        long = np.flatnonzero(np.subtract(ends, starts, dtype=np.int64) > LONG)
        if len(long):
            starts, ends = np.asarray(starts, np.int64)[long], np.asarray(ends, np.int64)[long]
            counts = -(-(ends - starts) // BLOCK)
            first = np.cumsum(counts) - counts
            number = np.arange(counts.sum()) - np.repeat(first, counts)
            start = np.repeat(starts, counts) + number * BLOCK
            end = np.minimum(start + BLOCK, np.repeat(ends, counts))
            parts = mix((prefix[end] - prefix[start]) * down[start])
            parts = mix(parts + number.astype(U64) * self.base)
            out[long] = mix(np.add.reduceat(parts, first) + (ends - starts).astype(U64))
        return out

    def rolling(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of each window of `width` values."""
        if len(values) < width:
            return np.zeros(0, U64)
        return self.windows(self.prefix(values), width)

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash of each window of at most LONG values, from prefix sums of `width` values or more."""
        _, down = self.powers(len(prefix))
        return mix((prefix[width:] - prefix[:-width]) * down[: len(prefix) - width])


LANES = (Lane(11), Lane(23))


@dataclass
class Chunk:
    """Rows first to last of a batch; the text of row first + i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array, size: int = 1 << 20, rows: int = 1 << 12) -> Iterator[Chunk]:
    """Consecutive rows of a string or binary column without nulls, about `size` bytes and at most `rows` rows at a time.

    A longer text makes a chunk of its own, so memory is bounded by the size and the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_string() if pa.types.is_string(column.type) else column.type
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else wide)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(len(column), first + rows, max(last, first + 1))
        yield Chunk(first, last, flat[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


@dataclass
class Words:
    """Maximal runs of bytes that are not white space; they never cross rows."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def per_row(self, rows: int) -> np.ndarray:
        """Bounds of the words of each row."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def words(chunk: Chunk) -> Words:
    solid = ~SPACE[chunk.data]
    n = len(solid)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    first = np.zeros(n + 1, bool)
    first[chunk.bounds] = True
    first[n] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(chunk.bounds, starts, "right") - 1
    return Words(starts, np.flatnonzero(finishes) + 1, row)


def word_hashes(chunk: Chunk, found: Words, lane: int = 0, lower: bool = False) -> np.ndarray:
    data = LOWER[chunk.data] if lower else chunk.data
    family = LANES[lane]
    return family.between(family.prefix(family.table[data]), found.starts, found.ends)


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The index of the smallest hash (its upper half, ties to the left) in each window of `width`."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    keys = (hashes & ~U64(2**32 - 1)) | np.arange(len(hashes), dtype=U64)
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    keys = np.minimum(keys[: len(keys) - rest], keys[rest:])
    return (keys & U64(2**32 - 1)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of equal values."""
    if not len(values):
        none = np.zeros(0, np.int64)
        return none, none
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
