"""SentencePiece encoding and decoding by vectorised merge rounds.

The model file is read for its pieces and their scores only. A text becomes
units that no piece crosses: a run of word-start marks and what follows it.
All units of a batch that a worker has not met lately lie in one flat symbol
array; each round finds, for every unit at once, its best pair (the highest
score, then the leftmost), merges it, and compacts the arrays, until no pair of
any unit is a piece. Where it cannot change the outcome, all the occurrences of
a unit's best piece merge in the same round, left to right.

When is that so? A merge may form a new pair that beats, or ties with, the
remaining occurrences. For each piece it is found once, from the vocabulary,
whether some piece that contains it scores as high; such pieces merge one
occurrence a round.

A round costs as much as the whole array, and some pieces merge one occurrence
a round, so long units are treated apart. They are first cut where two
characters stand side by side in no piece: no merge crosses such a place, and
the parts are units of their own. A part that is still longer than
``LONG_UNIT`` symbols is merged pair by pair in the same order from a sorted list
and a heap, in time n log n.

Symbols that are no piece fall back to byte pieces. Special pieces are never
made from text. Only models of identity normalisation are accepted, with a
dummy prefix, white space escaped and not collapsed, as the named file has.

Defined cases: null counts as empty; an empty text encodes to the end id alone
and decodes to the empty text; U+2581 in a text decodes to a space, as the
library does.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._units import UnitMemo, encode_spans

MARK = "▁"
#: Units kept by a worker in each of two generations.
MEMO_UNITS = 150_000
#: Symbols in a merge batch.
BATCH_SYMBOLS = 1 << 18
#: Symbols of a unit that is cut, and of a part that is not merged in rounds.
LONG_UNIT = 256
#: Bits of a position in a merge key.
PLACE_BITS = 40
#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20

ENCODED = "doc_id long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Tables of a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a BPE model of identity normalisation with a dummy prefix is needed")
        kinds = [p.type for p in model.pieces]
        if len(kinds) > 1 << 16:
            raise ValueError("more than 65,536 pieces")
        if 4 in kinds or 5 in kinds or not model.trainer_spec.byte_fallback:
            raise ValueError("user-defined or unused pieces, or no byte pieces: not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece crosses a word start")
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.type == 3 and p.piece == "</s>")
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        #: Id of each code point, or -1 - point.
        self.point_id = -1 - np.arange(0x110000)
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.point_id[ord(piece)] = i
        scores = np.array([p.score for p in model.pieces], np.float64)
        # Rank 0 is the best score; equal scores share a rank.
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self._pairs()
        self._outputs(kinds)

    def _pairs(self) -> None:
        """Hash table from a pair of symbols to the piece that they form."""
        left, right, out = [], [], []
        single = np.ones(len(self.pieces), bool)
        for piece, i in self.normal.items():
            for k in range(1, len(piece)):
                a, b = self.normal.get(piece[:k]), self.normal.get(piece[k:])
                # A part that is no piece must be one character without a piece: it has no id, and no merges.
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(i)
                    for part in (a, b):
                        if self.rank[i] <= self.rank[part]:
                            single[part] = False
            if len(piece) > 1:
                # Single characters join pieces even if they are not pieces themselves.
                for c in piece:
                    if c not in self.normal:
                        raise ValueError("a piece holds a character that is none")
        #: What a pair of ids forms, and the pairs of characters that stand in a piece.
        self.formed = {a << 16 | b: m for a, b, m in zip(left, right, out)}
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for p in self.normal for a, b in zip(p, p[1:])], np.uint64))
        #: Pieces of which all occurrences may merge in one round.
        self.together = single
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = 20
        size = 1 << self.bits
        self.table_key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.table_out = np.full(size, -1, np.int64)
        self.probes = 0
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.table_out[s] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.table_key[s[put]] = key[todo[put]]
            self.table_out[s[put]] = np.array(out)[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _outputs(self, kinds: list[int]) -> None:
        """Bytes that each id decodes to; byte pieces give their byte, special ones nothing."""
        parts = []
        for piece, kind in zip(self.pieces, kinds):
            if kind == 6:
                parts.append(bytes([int(piece[1:-1], 16)]))
            elif kind == 1:
                parts.append(piece.replace(MARK, " ").encode())
            else:
                parts.append(b"" if kind == 3 else " ⁇ ".encode())
        self.parts = parts
        self.starts_blank = np.array([p[:1] == b" " for p in parts])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair, or -1."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        found = np.where(self.table_key[slot] == key, self.table_out[slot], -1)
        miss = np.flatnonzero((found < 0) & (self.table_out[slot] >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & (len(self.table_out) - 1)
            here = slot[miss]
            same = self.table_key[here] == key[miss]
            found[miss[same]] = self.table_out[here[same]]
            miss = miss[~same & (self.table_out[here] >= 0)]
        return found

    def merge(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the units of a flat symbol array; ``unit`` numbers each symbol's unit.

        Negative symbols stand for characters without a piece.
        """
        done_s, done_u, done_o = [], [], []
        order = np.arange(len(symbols))
        none = np.iinfo(np.int64).max
        merged = None
        while len(symbols):
            n = len(symbols)
            if merged is None:
                merged = np.full(n, -1)
                ok = np.flatnonzero((unit[1:] == unit[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0))
                merged[ok] = self.lookup(symbols[ok], symbols[ok + 1])
            rank = np.where(merged >= 0, self.rank[merged], none)
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, n))
            live = np.repeat(best < none, size)
            if not live.all():
                rest = ~live
                done_s.append(symbols[rest])
                done_u.append(unit[rest])
                done_o.append(order[rest])
                symbols, unit, order, merged, rank = symbols[live], unit[live], order[live], merged[live], rank[live]
                size, best = size[best < none], best[best < none]
                n = len(symbols)
                if not n:
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # Of overlapping occurrences every second one merges, from the left.
            new_run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (unit[at[1:]] != unit[at[:-1]])))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - run_start) % 2 == 0
            if not self.together[merged[at]].all():
                leftmost = np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))
                keep &= self.together[merged[at]] | leftmost
            at = at[keep]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            alive = np.ones(n, bool)
            alive[at + 1] = False
            merged[at] = -1
            # Only pairs beside a merged symbol change.
            where = np.cumsum(alive) - 1
            symbols, unit, order, merged = symbols[alive], unit[alive], order[alive], merged[alive]
            at = where[at]
            beside = np.zeros(len(symbols), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            beside[-1] = False
            touched = np.flatnonzero(beside)
            merged[touched] = -1
            touched = touched[(unit[touched] == unit[touched + 1]) & (symbols[touched] >= 0) & (symbols[touched + 1] >= 0)]
            merged[touched] = self.lookup(symbols[touched], symbols[touched + 1])
        if not done_s:
            return symbols, unit
        s, u, o = np.concatenate(done_s), np.concatenate(done_u), np.concatenate(done_o)
        back = np.argsort(o, kind="stable")
        return s[back], u[back]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges for one long unit, in order of rank and place: a sorted list of the first pairs and a heap of new ones."""
        n, mask = len(symbols), (1 << PLACE_BITS) - 1
        formed, rank = self.formed.get, self.rank.tolist()
        first = self.lookup(symbols[:-1], symbols[1:])
        at = np.flatnonzero(first >= 0)
        keys = np.sort(self.rank[first[at]] << PLACE_BITS | at)
        symbol, after, before = array("i", symbols.tolist()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap: list[int] = []

        def in_order() -> Iterator[int]:
            for k in range(0, len(keys), 1 << 16):
                for key in keys[k : k + (1 << 16)].tolist():
                    while heap and heap[0] < key:
                        yield heappop(heap)
                    yield key
            while heap:
                yield heappop(heap)

        for key in in_order():
            i = key & mask
            j = after[i]
            if symbol[i] < 0 or j == n:
                continue
            m = formed(symbol[i] << 16 | symbol[j])
            # A key is stale where its pair is gone.
            if m is None or rank[m] != key >> PLACE_BITS:
                continue
            symbol[i], symbol[j] = m, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = formed(m << 16 | symbol[k])
                if x is not None:
                    heappush(heap, rank[x] << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                x = formed(symbol[h] << 16 | m)
                if x is not None:
                    heappush(heap, rank[x] << PLACE_BITS | h)
        out = np.array(symbol, np.int64)
        return out[out >= 0]

    def _parts(self, points: np.ndarray, symbols: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Part of each symbol: its unit, cut where no piece can stand if the unit is long."""
        starts = np.concatenate(([True], unit[1:] != unit[:-1]))
        at = np.flatnonzero((np.bincount(unit) > LONG_UNIT)[unit[1:]] & ~starts[1:])
        pair = points[at].astype(np.uint64) << np.uint64(32) | points[at + 1].astype(np.uint64)
        place = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        starts[at[(self.beside[place] != pair) | (symbols[at] < 0) | (symbols[at + 1] < 0)] + 1] = True
        return np.cumsum(starts) - 1

    def _merge_parts(self, points: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their units."""
        symbols = self.point_id[points]
        if not len(unit) or np.bincount(unit).max() <= LONG_UNIT:
            return self.merge(symbols, unit)
        part = self._parts(points, symbols, unit)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(first, len(part)))
        unit_of, long = unit[first], size > LONG_UNIT
        short = ~long[part]
        done = [self.merge(symbols[short], part[short])]
        for p in np.flatnonzero(long).tolist():
            merged = self.merge_long(symbols[first[p] : first[p] + size[p]])
            done.append((merged, np.full(len(merged), p)))
        s, p = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(p, kind="stable")
        return s[order], unit_of[p[order]]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as the bytes of 16-bit integers."""
        out: list[bytes] = []
        batch: list[str] = []
        size = 0
        for x in units:
            batch.append(x)
            size += len(x)
            if size >= BATCH_SYMBOLS:
                out += self._encode(batch)
                batch, size = [], 0
        return out + self._encode(batch) if batch else out

    def _encode(self, units: list[str]) -> list[bytes]:
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        symbols, unit = self._merge_parts(points, unit)
        strange = np.flatnonzero(symbols < 0)
        if len(strange):
            data = [chr(-1 - p).encode() for p in symbols[strange].tolist()]
            counts = np.ones(len(symbols), np.int64)
            counts[strange] = [len(x) for x in data]
            symbols, unit = np.repeat(symbols, counts), np.repeat(unit, counts)
            symbols[symbols < 0] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        edges = (2 * np.searchsorted(unit, np.arange(len(units) + 1))).tolist()
        data = symbols.astype(np.uint16).tobytes()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """Text bytes of ids: pieces joined, without the blank of the dummy prefix."""
        parts = self.parts
        data = b"".join(map(parts.__getitem__, ids.tolist()))
        return data[1:] if len(ids) and self.starts_blank[ids[0]] else data


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte buffer of the texts after the dummy prefix, and the units in it.

    Marks are still blanks. A unit starts at a blank that follows no blank.
    Returns buffer, starts, ends, and the first unit of each document.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    filled = pc.greater(pc.binary_length(texts), 0)
    texts = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
    texts = pc.replace_substring(texts, MARK, " ")
    buf, offsets = T.flat(texts)
    blank = buf == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begins[cuts] = True
    start = np.flatnonzero(begins)
    return buf, start, np.append(start[1:], len(buf)), np.searchsorted(start, offsets)


class Encoder:
    """A model and a worker's memory of recent units."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memo = UnitMemo(self._encode, MEMO_UNITS)

    def _encode(self, found: list[bytes]) -> list[bytes]:
        return self.model.encode_units([u.decode().replace(" ", MARK) for u in found])

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, the end id included."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        elif isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        buf, start, end, first = units(texts)
        ids, edges = encode_spans(buf, start, end, first, self.memo, np.uint16)
        tail = np.array([self.model.end_id], np.uint16)
        return [np.concatenate((ids[a:b], tail)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(docs: DataFrame) -> DataFrame:
    C.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (end id last) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        for table in C.bounded(batches, BATCH_BYTES):
            ids = coder.encode(table.column("text"))
            yield from pa.table({"doc_id": table.column("doc_id"), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}).to_batches()

    return _texts(docs).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of ids; bytes that are no UTF-8 become U+FFFD."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path).model
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode each document; return the number of ids, digests of both, and the ids if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        names = [str(i) for i in range(len(coder.model.pieces))]
        for table in C.bounded(batches, BATCH_BYTES):
            encoded = coder.encode(table.column("text"))
            columns = {
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(" ".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(coder.model.decode(x)).hexdigest() for x in encoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32()))
            yield from pa.table(columns).to_batches()

    return _texts(docs).mapInArrow(work, DIGEST + ", ids array<int>" * with_ids)
