"""Words of whole Arrow string columns as numpy arrays, without a Python step per word.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``; those are single bytes in UTF-8, so
the bytes of the column are cut directly. A word's 64-bit hash chains its blocks of eight bytes, each mixed in
by a function that is not linear, and ends with the length; words of more than ``LONG`` bytes take BLAKE2. Other
seeds give independent hashes. Null counts as empty. Work memory is bounded by ``PIECE`` bytes (or the longest
word) plus about 50 bytes per word of the batch, however long a text is.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 256 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n; kept for the usual piece size only."""
    size = max(n, PIECE + 1)
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(size, base, U64)
        table[0] = 1
        np.cumprod(table, out=table)
        if size == PIECE + 1:
            _powers[base] = table
    return table[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def give_back(cycles: bool = True) -> None:
    """Return freed memory to the system, since a Python worker outlives its task and the next one may run elsewhere.

    Looking for ``cycles`` takes 40 ms; what only makes arrays, and is called for each of many groups, has none."""
    _powers.clear()
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps the memory for the worker's next task
        pass


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over a task's batches, with memory given back at its end."""

    def whole(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, fold: bool = False, seed: int = 1) -> np.ndarray:
        """One hash per word; ``fold`` lower-cases A-Z."""
        out = np.empty(len(self.starts), U64)
        k, n = 0, len(self.starts)
        while k < n:
            origin = int(self.starts[k])
            to = max(k + 1, int(np.searchsorted(self.ends, origin + PIECE, "right")))
            data = self.data[origin : int(self.ends[to - 1])]
            out[k:to] = _chained(_LOWER[data] if fold else data, self.starts[k:to] - origin, self.ends[k:to] - origin, seed)
            k = to
        return out

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i joined by one space; ``keep`` marks the words to take."""
        lo, hi = int(self.first[i]), int(self.first[i + 1])
        if hi == lo:
            return b""
        origin = int(self.starts[lo])
        data = self.data[origin : int(self.ends[hi - 1])]
        s, e = self.starts[lo:hi] - origin, self.ends[lo:hi] - origin
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        mark = np.zeros(len(data) + 2, np.int8)
        np.add.at(mark, s, 1)
        np.add.at(mark, e + 1, -1)  # each word with one byte after it
        take = np.cumsum(mark[: len(data) + 1]).astype(bool)
        body = np.append(data, np.uint8(32))
        body[e] = 32
        return body[take].tobytes()[:-1]


def _chained(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    size, key = ends - starts, hashlib.blake2b(b"%d" % seed, digest_size=16).digest()
    first, factor = np.frombuffer(key, U64)
    view = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    out, live, at = np.full(len(starts), first, U64), np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        block = view[starts[live] + at] & (~U64(0) >> (U64(8) * (8 - np.minimum(left, 8)).astype(U64)))
        out[live] = mix((out[live] ^ block) * (factor | U64(1)))
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return mix(out ^ size.astype(U64) * U64(_BASE))


def split_words(column: pa.Array | pa.ChunkedArray) -> Words:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    base = int(offsets[0])  # a slice shares the buffer of its whole batch
    data = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - base
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a text's first word starts at the text
    starts = np.flatnonzero(inside & ~before)
    after = inside[1:].copy()
    cuts = offsets[1:] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, first)


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes at each start; texts are not told apart here."""
    if len(h) < size:
        return np.empty(0, U64)
    base = (0xD6E8FEB86659FD93 + 2 * seed) | 1
    n, block = len(h) - size + 1, PIECE // 2
    out = np.empty(n, U64)
    for lo in range(0, n, block):
        part = h[lo : lo + block + size - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _power(base, len(part)), out=sums[1:])
        m = len(part) - size + 1
        out[lo : lo + m] = (sums[size:] - sums[:m]) * _power(pow(base, -1, 1 << 64), m)
    return mix(out)
