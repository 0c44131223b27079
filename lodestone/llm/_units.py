"""Dictionary encoding of a batch's units, shared by the tokenising operators.

Units (spans that no token crosses) are hashed in one numpy pass and grouped by
hash; Python touches each distinct unit of a batch once. A worker keeps the ids
of units that it has met lately in two generations of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lodestone.llm import _text as T


class UnitMemo:
    """Ids of recent units, as bytes; at most twice ``limit`` of up to ``longest`` bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = 400_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, units: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        out = [new.get(u) for u in units]
        todo = [k for k, v in enumerate(out) if v is None]
        fresh = []
        for k in todo:
            u = units[k]
            v = old.get(u)
            if v is None:
                fresh.append(k)
            else:
                out[k] = new[u] = v
        if fresh:
            for k, v in zip(fresh, self.encode([units[k] for k in fresh])):
                out[k] = v
                if len(units[k]) <= self.longest:
                    new[units[k]] = v
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out


def encode_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, memo: UnitMemo, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all spans in order, and where each document's ids start (one entry more)."""
    dtype = np.dtype(dtype)
    if not len(start):
        return np.zeros(0, dtype), np.zeros(len(first), np.int64)
    _, at, inverse = np.unique(T.span_hashes(buf, start, end, False), return_index=True, return_inverse=True)
    data = buf.tobytes()
    coded = memo.get([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // dtype.itemsize
    flat = np.frombuffer(b"".join(coded), dtype)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    lengths = sizes[inverse]
    ends = np.cumsum(lengths)
    shift = begin[inverse] - (ends - lengths)
    ids = flat[np.repeat(shift, lengths) + np.arange(int(ends[-1]))]
    return ids, np.concatenate(([0], ends))[first]
