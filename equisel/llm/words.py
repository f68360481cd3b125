"""Words of Arrow text columns as numpy arrays.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes outside a
256-entry separator table; every separator used here is ASCII, so multi-byte
characters are never cut. Hashes are 64-bit and seeded by constants only, so a
recomputed task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_LETTER = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0xA0761D6478BD642F)
_POWER = np.ones(1, dtype=U)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[c for c in range(128) if not chr(c).isalnum()]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _pow(q: np.uint64, n: int) -> np.uint64:
    return U(pow(int(q), n, 1 << 64))


def _powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base (doubled when a longer word comes)."""
    global _POWER
    while len(_POWER) < n:
        _POWER = np.concatenate([_POWER, _POWER * _pow(_BASE, len(_POWER))])
    return _POWER


def text_array(column) -> pa.Array:
    """A plain string array without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges of about ``limit``
    bytes; a longer text makes a block of its own."""
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of one block: byte ``start`` and ``end``, the row ``doc`` (from
    the block's first row), ``first`` word of every row (one more at the end)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, separators: np.ndarray):
        keep = ~separators[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offs] = True
        begins = keep.copy()
        begins[1:] &= ~keep[:-1] | edge[1 : len(raw)]
        ends = keep.copy()
        ends[:-1] &= ~keep[1:] | edge[1 : len(raw)]
        self.raw, self.keep = raw, keep
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, dtype=U)
        size = self.end - self.start
        return segment_hashes(self.raw[self.keep], np.cumsum(size) - size, size)


def segment_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every segment of ``raw``; the segments follow each other."""
    place = np.arange(len(raw)) - np.repeat(start, size)
    return mix(np.add.reduceat(_LETTER[raw] * _powers(int(size.max()))[place], start) ^ size.astype(U))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries of ``h`` (order matters)."""
    if len(h) < n:
        return np.zeros(0, dtype=U)
    total, length, power, step, q = None, 0, h, 1, U(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        while True:  # join doubled runs along the binary digits of n
            if n & step:
                if total is None:
                    total = power
                else:
                    m = min(len(power) - length, len(total))
                    total = total[:m] + power[length : length + m] * _pow(q, length)
                length += step
            if length == n:
                return mix(total[: len(h) - n + 1])
            power = power[:-step] + power[step:] * _pow(q, step)
            step *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive entries."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
