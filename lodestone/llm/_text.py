"""Vectorised words and hashes over Arrow string buffers.

A list of texts is one flat byte buffer plus offsets. Words are found with a
256-entry byte class table, so a batch costs a few numpy passes instead of a
Python object per word. Every hash is a fixed function of the bytes: it is the
same in each worker process, which Python's own ``hash`` is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time; keeps the temporary arrays small for any text length.
SEGMENT = 1 << 18

_C1, _C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * _C1
    x ^= x >> U64(33)
    x = x * _C2
    x ^= x >> U64(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv_base = base, _inverse(base)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(10, (n - 1).bit_length())
            self.up = self._series(self.base, size)
            self.down = self._series(self.inv_base, size)
        return self.up, self.down

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.full(size, U64(base), U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WINDOW = {0: _Powers(0xD6E8FEB86659FD93), 1: _Powers(0xA0761D6478BD642F)}


def byte_class(excluded: str) -> np.ndarray:
    """Table of the bytes that belong to words: all but those of ``excluded`` ranges."""
    table = np.ones(256, bool)
    for part in excluded.split():
        lo, _, hi = part.partition("-")
        table[int(lo, 16) : int(hi or lo, 16) + 1] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class("20 09-0D")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z is lower-cased.
PLAIN = byte_class("00-2F 3A-60 7B-7F")
PLAIN_UPPER = PLAIN.copy()
PLAIN_UPPER[65:91] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=texts.offset * 8) if n else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


class Words:
    """Words of a batch: byte spans in document order, plus each document's first word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.buf = buf
        inside = table[buf]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1]
        cuts = cuts[cuts < len(buf)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = cuts[cuts > 0] - 1
        after[ends] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n_docs = len(offsets) - 1

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        """Words of each document."""
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def position(self) -> np.ndarray:
        """Index of each word within its document."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word, of the lower-cased word if ``lower`` (A-Z only)."""
        return span_hashes(self.buf, self.start, self.end, lower)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    values = _VALUES[lower]
    n = len(start)
    out = np.empty(n, U64)
    i = 0
    while i < n:
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + SEGMENT)))
        top = int(end[j - 1])
        size = top - base
        up, down = _BYTES.get(size + 1)
        sums = np.empty(size + 1, U64)
        sums[0] = 0
        np.cumsum(values[buf[base:top]] * up[:size], out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries; entry i covers i..i+width-1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if width <= 8:
        base = U64(_WINDOW[family].base)
        out = hashes[:n].copy()
        for k in range(1, width):
            out *= base
            out += hashes[k : k + n]
        return mix(out)
    out = np.empty(n, U64)
    step = SEGMENT
    up, down = _WINDOW[family].get(min(n, step) + width + 1)
    for i in range(0, n, step):
        j = min(n, i + step)
        size = j - i + width - 1
        sums = np.empty(size + 1, U64)
        sums[0] = 0
        np.cumsum(hashes[i : i + size] * up[:size], out=sums[1:])
        out[i:j] = (sums[width : width + j - i] - sums[: j - i]) * down[: j - i]
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spread(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Mask of the positions covered by ``[start, start+width)`` of any start."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.clip(starts, 0, n), 1)
    np.add.at(delta, np.clip(starts + width, 0, n), -1)
    return np.cumsum(delta[:-1]) > 0
