"""Whole texts as flat arrays: bytes, words and hashes of any span.

A batch of texts is one byte array with offsets, cut into parts of bounded
size, so a task's memory does not depend on how many rows a batch has. Hashes
are polynomial prefix sums modulo 2**64 over random byte values; the hash of
any span then costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 2 << 20
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = 2**31 - 1
_P = np.uint64(_PRIME)
_PRIME_BASE = 1_386_574_093
_PRIME_INVERSE = pow(_PRIME_BASE, -1, _PRIME)
_POWERS: dict[int, np.ndarray] = {}
_PRIME_POWERS: dict[int, np.ndarray] = {}


def _room(n: int) -> int:
    """Powers to hold for ``n``: a few sizes only, and no more than the parts in use need."""
    step = max(1 << n.bit_length() >> 2, 1 << 12)
    return -(-n // step) * step


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(_room(n), 1)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 2 * PART_BYTES:
            _POWERS[base] = held
    return held[:n]


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    held = _PRIME_POWERS.get(base)
    if held is None or len(held) < n:
        size = max(_room(n), 1)
        held = np.ones(1, np.uint64)
        while len(held) < size:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), _PRIME)) % _P])
        held = held[:size]
        if size <= 2 * PART_BYTES:
            _PRIME_POWERS[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)
        self.prime_sums = np.zeros(n + 1, np.uint64)  # below 2**64 for any text below 2**33 values
        np.cumsum(values % _P * prime_powers(_PRIME_BASE, n) % _P, out=self.prime_sums[1:])
        self.prime_back = prime_powers(_PRIME_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        wrapped = (self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64)
        prime = (self.prime_sums[ends] - self.prime_sums[starts]) % _P * self.prime_back[starts] % _P
        return mix(wrapped + mix(prime))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Texts:
    """A part of a batch: rows ``first`` .. ``first + n`` of it."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def spans(self) -> Spans:
        return Spans(_RANDOM[self.data])

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        space = _SPACE[self.data]
        size = len(space)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        begins, ends = ~space, ~space
        if size:
            begins[1:] &= space[:-1] | edge[1:-1]
            ends[:-1] &= space[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def word_starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Index of each row's first word, with the total as the last entry."""
        return np.searchsorted(self.word_starts, self.offsets)

    @cached_property
    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.spans.of(self.word_starts, self.word_ends)


def parts(column: pa.Array, limit: int = PART_BYTES) -> Iterator[Texts]:
    """Null counts as empty. A row longer than ``limit`` is a part of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, held = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1]
        yield Texts(first, data[own[0] : own[-1]], own - own[0])
        first = last


def windows(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of ``width`` words inside one row, and its row."""
    left = texts.word_bounds[texts.word_rows + 1] - np.arange(len(texts.word_rows)) if len(texts.word_rows) else np.zeros(0, int)
    first = np.flatnonzero(left >= width)
    return first, texts.word_rows[first]


def lower_ascii(texts: Texts) -> Texts:
    upper = (texts.data >= 65) & (texts.data <= 90)
    return Texts(texts.first, texts.data + upper.astype(np.uint8) * np.uint8(32), texts.offsets)
