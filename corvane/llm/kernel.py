"""Vectorised word kernel shared by the text operators.

The kernel works on the bytes of an Arrow string column: it finds word boundaries with a lookup
table, and hashes every word at once from a prefix sum of ``T[byte] * p**position`` (mod 2**64).
No Python object is made for a word.  Texts are taken in runs of about ``CHUNK`` bytes, one text at
least, so memory follows the longest text and never the size of a partition.

Null texts count as empty.  A word never crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 512 << 10
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse mod 2**64
_P_INV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: One fixed random value for each byte; upper-case ASCII letters share the value of their lower case.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

#: Bytes that are not part of a blank-separated word: space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are not part of an alphanumeric word; every non-ASCII byte is a letter here.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, at least ``n`` of them."""
    global _powers, _inverse
    if len(_powers) < n:
        for base, name in ((_P, "_powers"), (_P_INV, "_inverse")):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            globals()[name] = np.multiply.accumulate(full)
    return _powers, _inverse


@dataclass
class Run:
    """Some whole texts: ``buf`` holds their bytes, text ``i`` is ``buf[off[i]:off[i + 1]]``."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def runs(column: pa.Array, limit: int = CHUNK) -> Iterator[Run]:
    """Split a string or binary column into runs of at most ``limit`` bytes (or one text)."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Run(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Words of a run: ``start`` and ``end`` in bytes; text ``i`` has words ``ptr[i]:ptr[i + 1]``."""

    run: Run
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def doc(self) -> np.ndarray:
        """The text of each word, as its index in the run."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def prefix_sums(self, lower: bool = True) -> np.ndarray:
        pw, _ = _grow(len(self.run.buf) + 1)
        sums = np.zeros(len(self.run.buf) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.run.buf] * pw[: len(self.run.buf)], out=sums[1:])
        return sums

    def span_hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes between ``start`` and ``end``, the same wherever they stand."""
        _, inv = _grow(len(self.run.buf) + 1)
        return mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))

    def hashes(self, lower: bool = True) -> np.ndarray:
        return self.span_hash(self.prefix_sums(lower), self.start, self.end)


def words(run: Run, breaks: np.ndarray = BLANK) -> Words:
    """Maximal stretches of bytes that ``breaks`` doesn't mark, cut where a text ends."""
    inside = np.zeros(len(run.buf) + 2, bool)
    inside[1:-1] = ~breaks[run.buf]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edge = run.off[1:-1]
    begin[edge[edge < len(run.buf)]] = inside[edge[edge < len(run.buf)] + 1]
    last = edge[edge > 0] - 1
    stop[last] = inside[last + 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(run, start, end, np.searchsorted(start, run.off))


def sums_by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each slice ``off[i]:off[i + 1]``; empty slices give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def windows(h: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows that stay within a text, and their pointers by text."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(len(ptr), np.int64)
    m = len(h) - size + 1
    out = np.zeros(m, np.uint64)
    for k in range(size):
        out = out * np.uint64(_P) + h[k : k + m]
    counts = np.maximum(np.diff(ptr) - size + 1, 0)
    new = np.zeros(len(ptr), np.int64)
    np.cumsum(counts, out=new[1:])
    keep = np.repeat(ptr[:-1] - new[:-1], counts) + np.arange(new[-1])
    return mix64(out[keep]), new
