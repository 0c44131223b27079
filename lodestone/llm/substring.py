"""Substring dedup by difference-cover anchors.

A window of ``WIDTH`` words is a repeat if the same words start in a document
with a smaller id. Two equal windows start at positions i and j; with a
difference cover D modulo the period p there is a shift k < p for which both
i+k and j+k fall on positions whose residue is in D. So if anchors (hashes of
``WIDTH - p + 1`` words) are taken only at cover positions, any two equal
windows hold a common anchor at the same shift. With p = 7 and D = {0, 1, 3},
three positions of seven are hashed, and an anchor is 7 words long.

1. Each chunk sends its distinct anchors; a bucket marks those that stand in
   two chunks. (Anchors shared inside a chunk are found on the spot.)
2. A marked anchor *extends*: only the 13-word windows around marked anchors
   are hashed in full and sent with the smallest document id of the chunk.
   The bucket says whether a smaller document elsewhere starts the window.
3. The chunk marks the covered words and drops them.

A passage that a third of all documents share is one entry per chunk in either
step. Texts are moved once; no document pairs are formed.

Defined cases: a null text has no words; an empty text too; a document of fewer
than 13 words is unchanged; a null doc_id is neither smaller nor larger than
any id, so such rows are unchanged and never remove words from others; rows of
one doc_id do not remove words from each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T

WIDTH = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CUT = "doc_id long, n_words long, n_removed long, kept_text string"


def _words(table: pa.Table) -> T.Words:
    return T.Words(*T.flat(table.column("text")), T.SPACED)


def _anchors(words: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the cover positions with a whole anchor, and their hashes."""
    position, left = words.position(), np.repeat(words.counts, words.counts)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    at = np.flatnonzero(cover[position % PERIOD] & (position + ANCHOR <= left) & (left >= WIDTH))
    return at, T.windows(hashes, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)


def _shared_here(inverse: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Keys that stand in two documents of the chunk."""
    low = np.full(n, np.iinfo(np.int64).max)
    high = np.full(n, -1)
    np.minimum.at(low, inverse, docs)
    np.maximum.at(high, inverse, docs)
    return low != high


class _Windows:
    """Full windows around shared anchors: their words, keys and documents."""

    def __init__(self, words: T.Words, hashes: np.ndarray, docs: np.ndarray, anchors: np.ndarray, ids: np.ndarray, known: np.ndarray, bits: int):
        n = len(words)
        near = T.spread(np.maximum(anchors - PERIOD + 1, 0), np.minimum(anchors, PERIOD - 1) + 1, n)
        position, left = words.position(), np.repeat(words.counts, words.counts)
        self.at = np.flatnonzero(near & (position + WIDTH <= left) & known[docs])
        full = T.windows(hashes, WIDTH)
        other = T.windows(hashes, WIDTH, 1)
        key, side = (full[self.at], other[self.at]) if len(self.at) else (np.zeros(0, np.uint64),) * 2
        bucket = side >> np.uint64(64 - bits)
        order = np.lexsort((key, bucket))
        k, b = key[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        self.keys, self.buckets = k[new], b[new].astype(np.int64)
        self.inverse = np.empty(len(k), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.ids = ids[docs[self.at]]
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.inverse, self.ids)


def _flags(replies: dict[int, tuple[int, bytes]], of: np.ndarray, bits: int) -> np.ndarray:
    """One flag for each sent key from the buckets' bit sets."""
    out = np.zeros(len(of), bool)
    edges = np.searchsorted(of, np.arange((1 << bits) + 1))
    for bucket, (n, reply) in replies.items():
        out[edges[bucket] : edges[bucket] + n] = np.unpackbits(np.frombuffer(reply, np.uint8), count=n).view(bool)
    return out


def _shared_anchors(table: pa.Table, replies: dict, bits: int) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    words = _words(table)
    hashes = words.hashes()
    docs = words.doc()
    at, h = _anchors(words, hashes)
    keys, inverse = np.unique(C.narrow_keys(h, bits), return_inverse=True)
    elsewhere = _flags(replies, (keys >> np.uint64(32)).astype(np.int64), bits)
    marked = elsewhere | _shared_here(inverse, docs[at], len(keys))
    return words, hashes, docs, at[marked[inverse]]


def _two_chunks(bucket: int, rows: list[dict]):
    """Flags of the keys that two chunks sent."""
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    flag = np.empty(len(k), bool)
    flag[order] = twin
    for row, part in zip(rows, np.split(flag, np.cumsum(sizes)[:-1])):
        if part.any():
            yield row["chunk"], row["n"], np.packbits(part).tobytes()


def _smaller_elsewhere(bucket: int, rows: list[dict]):
    """Flags of the windows that start in a smaller document of another chunk."""
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    least = np.concatenate([_unpack_ids(r["extra"], r["n"]) for r in rows])
    order = np.lexsort((least, keys))
    k, ids = keys[order], least[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    low = ids[first][np.cumsum(first) - 1]
    flag = np.empty(len(k), bool)
    flag[order] = low < ids
    for row, part in zip(rows, np.split(flag, np.cumsum(sizes)[:-1])):
        if part.any():
            yield row["chunk"], row["n"], np.packbits(part).tobytes()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as a dictionary and indices; a chunk has few documents to a bucket."""
    values, index = np.unique(ids, return_inverse=True)
    width = np.uint16 if len(values) < 1 << 16 else np.uint32
    return len(values).to_bytes(4, "little") + values.astype(np.int64).tobytes() + index.astype(width).tobytes()


def _unpack_ids(data: bytes, n: int) -> np.ndarray:
    count = int.from_bytes(data[:4], "little")
    values = np.frombuffer(data, np.int64, count, 4)
    width = np.uint16 if count < 1 << 16 else np.uint32
    return values[np.frombuffer(data, width, n, 4 + 8 * count)]


def covered_words(docs: DataFrame, finish, schema, chunk_bytes: int = C.CHUNK_BYTES, whole: bool = False) -> DataFrame:
    """Run ``finish(table, words, covered)`` on each chunk, with a mask of its repeated words."""
    spark = docs.sparkSession
    parts, bits = C.partitions(spark), C.bucket_bits(spark)
    chunks = C.pack(docs, parts, chunk_bytes, whole)

    def ask(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _words(C.load(payload.as_py()))
                _, h = _anchors(words, words.hashes())
                yield from C.asks(chunk, bits, np.unique(C.narrow_keys(h, bits)), True).to_batches()

    def extend(chunk, table, replies):
        words, hashes, docs_of, anchors = _shared_anchors(table, replies, bits)
        ids, known = C.doc_ids(table)
        w = _Windows(words, hashes, docs_of, anchors, ids, known, bits)
        return C.asks(chunk, bits, w.keys, False, lambda s: _pack_ids(w.least[s]), shift_key=w.buckets)

    def cut(chunk, table, replies):
        # Replies of both rounds: the second round's buckets are offset by the number of buckets.
        first = {b: r for b, r in replies.items() if b < 1 << bits}
        second = {b - (1 << bits): r for b, r in replies.items() if b >= 1 << bits}
        words, hashes, docs_of, anchors = _shared_anchors(table, first, bits)
        ids, known = C.doc_ids(table)
        w = _Windows(words, hashes, docs_of, anchors, ids, known, bits)
        below = _flags(second, w.buckets, bits)
        repeat = (w.ids > w.least[w.inverse]) | below[w.inverse]
        return finish(table, words, T.spread(w.at[repeat], WIDTH, len(words)))

    asked = chunks.mapInArrow(ask, C.ASK_SCHEMA)
    shared = C.answer(asked, parts, _two_chunks)
    extended = C.meet(chunks, shared, parts, extend, C.ASK_SCHEMA)
    repeats = C.answer(extended, parts, _smaller_elsewhere)
    both = shared.unionByName(repeats.withColumn("bucket", F.col("bucket") + F.lit(1 << bits)))
    return C.meet(chunks, both, parts, cut, schema)


def kept_words(words: T.Words, covered: np.ndarray) -> list[bytes]:
    """Kept words of each document joined by one space."""
    keep = np.flatnonzero(~covered)
    bounds = np.searchsorted(keep, words.first)
    data, start, end = words.buf.tobytes(), words.start[keep].tolist(), words.end[keep].tolist()
    return [b" ".join([data[start[i] : end[i]] for i in range(a, b)]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _counts(table: pa.Table, words: T.Words, covered: np.ndarray) -> list[pa.Array]:
    sums = np.concatenate(([0], np.cumsum(covered)))
    return [
        table.column("doc_id").combine_chunks(),
        pa.array(words.counts.astype(np.int64)),
        pa.array((sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)),
    ]


def _texts(table: pa.Table, words: T.Words, covered: np.ndarray) -> pa.Table:
    """The text without its repeated words; a text that loses none stays as it is, null included."""
    arrays = _counts(table, words, covered)
    removed = arrays[2].to_numpy()
    old = table.column("text").combine_chunks()
    new = kept_words(words, covered)
    texts = [new[i].decode() if removed[i] else old[i].as_py() for i in range(len(removed))]
    return pa.Table.from_arrays([*arrays, pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _digests(table: pa.Table, words: T.Words, covered: np.ndarray) -> pa.Table:
    arrays = _counts(table, words, covered)
    digests = [hashlib.sha256(x).hexdigest() for x in kept_words(words, covered)]
    return pa.Table.from_arrays([*arrays, pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    return covered_words(docs, _texts, CUT)


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words, all columns kept; ``n_chars``, where there, is the new text's.

    Texts that lose no word stay as they are.
    """
    names = docs.columns

    def finish(table: pa.Table, words: T.Words, covered: np.ndarray) -> pa.Table:
        cut = _texts(table, words, covered)
        changed = pc.greater(cut.column("n_removed"), 0)
        for name, new in (("text", cut.column("kept_text")), ("n_chars", pc.utf8_length(cut.column("kept_text")))):
            if name in names:
                k = names.index(name)
                table = table.set_column(k, table.schema.field(k), pc.if_else(changed, new.cast(table.schema.field(k).type), table.column(k)))
        return table

    return covered_words(docs, finish, docs.schema, whole=True)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """As ``dedup`` with the SHA-256 of the kept words joined by one space in place of the text."""
    return covered_words(docs, _digests, RESULT)
