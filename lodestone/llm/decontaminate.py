"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's normalised windows (13 consecutive item words; an item of fewer
words, but not none, is one window) go to every task as sorted hash arrays. A
task scans each document once: it rolls a hash over the document's words for
each window length in use, looks it up, and verifies each hit word by word
before it counts.

The broadcast has a proven size: items are cut into blocks of at most
``BLOCK_BYTES`` of text (one item at least), whose index takes about five times
their bytes. A benchmark of several blocks is scanned block by block: the
documents are written once with a number for each row, every block is a pass of
its own over them that yields the rows it hits, and the few hits are joined by
the row's number. A task holds one block at a time.

Defined cases: null and empty texts have no words; null items and items without
words match nothing; repeated items count each under its own id; a document
without words is not contaminated. Null ids are carried along. Other columns
are ignored by ``scan`` and kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.session import materialise

WIDTH = 13
#: Text bytes of the test items in one broadcast block.
BLOCK_BYTES = 32 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

SCAN = "doc_id long, n_words long, n_hit long, items array<string>, hits binary"


class NgramSet:
    """Windows of a block of test items: sorted hashes and places in the items' words."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WIDTH):
        self.words = words = T.Words(*T.flat(pa.array(texts, pa.string())), T.PLAIN_UPPER)
        hashes = words.hashes(lower=True)
        self.ids = ids
        self.item = words.doc()
        counts = words.counts
        size_of = np.minimum(counts, width)
        left = np.repeat(words.first[1:], counts) - np.arange(len(words))
        #: For each window length: sorted hashes, and where their windows start.
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(size_of[size_of > 0]).tolist():
            at = np.flatnonzero((size_of[self.item] == size) & (left >= size))
            keys = T.windows(hashes, size)[at]
            order = np.argsort(keys, kind="stable")
            self.by_size[size] = keys[order], at[order]
        #: Texts of the windows of a hash with their items, for hashes that were met.
        self.met: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    @staticmethod
    def _text(words: T.Words, start: int, size: int) -> bytes:
        spans = zip(words.start[start : start + size].tolist(), words.end[start : start + size].tolist())
        return b" ".join([bytes(words.buf[a:b]) for a, b in spans]).lower()

    def _windows(self, size: int, key: int) -> dict[bytes, set[str]]:
        found = self.met.get((size, key))
        if found is None:
            keys, at = self.by_size[size]
            lo, hi = np.searchsorted(keys, np.uint64(key), "left"), np.searchsorted(keys, np.uint64(key), "right")
            found = self.met[size, key] = {}
            for place in at[lo:hi].tolist():
                found.setdefault(self._text(self.words, place, size), set()).add(self.ids[self.item[place]])
        return found

    def scan(self, words: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Mask of the hit words and the items found in each document."""
        hit = np.zeros(len(words), bool)
        items: list[set[str]] = [set() for _ in range(words.n_docs)]
        if not len(words):
            return hit, items
        left = np.repeat(words.first[1:], words.counts) - np.arange(len(words))
        docs = words.doc()
        for size, (keys, _) in self.by_size.items():
            h = T.windows(hashes, size)
            at = np.flatnonzero(self._maybe(h, keys))
            at = at[left[at] >= size]
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            good = []
            for i in at.tolist():
                same = self._windows(size, int(h[i])).get(self._text(words, i, size))
                if same:
                    good.append(i)
                    items[docs[i]] |= same
            if good:
                hit |= T.spread(np.array(good), size, len(words))
        return hit, items

    @staticmethod
    def _maybe(h: np.ndarray, keys: np.ndarray, bits: int = 20) -> np.ndarray:
        """Cheap test by the leading bits; no key is missed."""
        table = np.zeros(1 << bits, bool)
        table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return table[(h >> np.uint64(64 - bits)).astype(np.int64)]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[str], list[str]]]:
    """Items in blocks of at most ``limit`` bytes of text (one item at least), streamed to the driver."""
    ids, texts, size = [], [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in items.where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _scanned(docs: DataFrame, ids: list[str], texts: list[str], width: int, key: str, hit_only: bool) -> DataFrame:
    """key, n_words, n_hit, items and hits of each row, or of the rows that the block hits."""
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast((ids, texts))
    memo: list[NgramSet] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.bounded(batches):
            if not memo:
                memo.append(NgramSet(*block.value, width))
            words = T.Words(*T.flat(table.column("text")), T.PLAIN_UPPER)
            hit, found = memo[0].scan(words, words.hashes(lower=True))
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            hits = [np.packbits(hit[words.first[i] : words.first[i + 1]]).tobytes() if n_hit[i] else None for i in range(words.n_docs)]
            out = pa.table(
                {
                    key: table.column(key),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_hit": pa.array(n_hit.astype(np.int64)),
                    "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    "hits": pa.array(hits, pa.binary()),
                }
            )
            yield from (out.filter(pa.array(n_hit > 0)) if hit_only else out).to_batches()

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(work, SCAN.replace("doc_id", key, 1))


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """The hits of one row in all blocks, a few at most, as one."""
    hits = [np.frombuffer(x, np.uint8) for x in table.column("hits").to_pylist()]
    mask = np.bitwise_or.reduce(hits)
    items = sorted(set().union(*table.column("items").to_pylist()))
    n_hit = int(np.bitwise_count(mask).sum())
    return pa.table({"row": pa.array([key[0].as_py()]), "n_hit": pa.array([n_hit], pa.int64()), "items": pa.array([items], pa.list_(pa.string())), "hits": pa.array([mask.tobytes()], pa.binary())})


def _numbered(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a number ``row`` (in a struct of their own, ``kept``), and n_words, n_hit, items and hits by that number."""
    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    kept = materialise(kept, "rows")
    texts = kept.select("row", F.col("kept.text").alias("text"))
    every, found = None, None
    for ids, items in blocks(benchmark, block_bytes):
        # The first pass counts the words of all rows as well.
        part = _scanned(texts, ids, items, width, "row", every is not None)
        if every is None:
            part = every = materialise(part, "scan")
        part = part.where("n_hit > 0").select("row", "items", "hits")
        found = part if found is None else found.unionByName(part)
    hits = found.groupBy("row").applyInArrow(_joined, "row long, n_hit long, items array<string>, hits binary")
    none = F.array().cast("array<string>")
    out = every.select("row", "n_words").join(hits, "row", "left")
    return kept, out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), "hits")


def _few(benchmark: DataFrame, block_bytes: int) -> tuple[list[str], list[str]] | None:
    """The whole benchmark, if it is one block at most."""
    first = list(islice(blocks(benchmark, block_bytes), 2))
    return None if len(first) > 1 else first[0] if first else ([], [])


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids found) and hits (bit set over the words) of each document."""
    C.tune(docs.sparkSession)
    few = _few(benchmark, block_bytes)
    if few:
        return _scanned(docs, *few, width, "doc_id", False)
    kept, found = _numbered(docs.select("doc_id", "text"), benchmark, width, block_bytes)
    ids = kept.select("row", F.col("kept.doc_id").cast("long").alias("doc_id"))
    return ids.join(found, "row").select("doc_id", "n_words", "n_hit", "items", "hits")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the items found, verdict."""
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not contaminated.

    With a benchmark of one block, the verdict is taken where the row is, so rows are neither joined nor moved.
    """
    return _rewrite(docs, benchmark, width, block_bytes, spans=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs``; from first to last word of each run of hit words, the text is cut."""
    return _rewrite(docs, benchmark, width, block_bytes, spans=True)


def _rewrite(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, spans: bool) -> DataFrame:
    C.tune(docs.sparkSession)
    few = _few(benchmark, block_bytes)
    if few:
        block, memo = docs.sparkSession.sparkContext.broadcast(few), []

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in C.bounded(batches):
                if not memo:
                    memo.append(NgramSet(*block.value, width))
                words = T.Words(*T.flat(table.column("text")), T.PLAIN_UPPER)
                hit, _ = memo[0].scan(words, words.hashes(lower=True))
                yield from _decided(table, words, hit, spans).to_batches()

        return docs.mapInArrow(work, docs.schema)
    kept, found = _numbered(docs, benchmark, width, block_bytes)
    bits_of = "hits"
    while bits_of.lower() in {c.lower() for c in docs.columns}:
        bits_of = f"_{bits_of}"
    if not spans:
        return kept.join(found.where(~contaminated()).select("row"), "row").select("kept.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.bounded(batches):
            words = T.Words(*T.flat(table.column("text")), T.PLAIN_UPPER)
            bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)).astype(bool) if x else np.zeros(n, bool) for x, n in zip(table.column(bits_of).to_pylist(), words.counts)]
            yield from _decided(table.drop_columns([bits_of]), words, np.concatenate(bits) if bits else np.zeros(0, bool), True).to_batches()

    hits = found.where("n_hit > 0").select("row", F.col("hits").alias(bits_of))
    return kept.join(hits, "row", "left").select("kept.*", bits_of).mapInArrow(cut, docs.schema)


def _decided(table: pa.Table, words: T.Words, hit: np.ndarray, spans: bool) -> pa.Table:
    """The rows that are not contaminated, or all rows without the hit words."""
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
    if not spans:
        return table.filter(pa.array(~((n_hit > 0) & (ONE_IN * n_hit >= words.counts))))
    column = table.schema.get_field_index("text")
    texts = table.column("text").combine_chunks()
    new = [_without(texts[i].as_py(), words, hit, i) if n_hit[i] else texts[i].as_py() for i in range(table.num_rows)]
    return table.set_column(column, table.schema.field(column), pa.array(new, table.schema.field(column).type))


def _without(text: str, words: T.Words, hit: np.ndarray, doc: int) -> str:
    a, b = int(words.first[doc]), int(words.first[doc + 1])
    data = text.encode()
    # The document's first byte in the buffer: its first word's place there less its place in the text.
    lead = int(np.argmax(T.PLAIN_UPPER[np.frombuffer(data, np.uint8)]))
    base = int(words.start[a]) - lead
    starts, ends = T.runs(hit[a:b])
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        out.append(data[at : int(words.start[a + s]) - base])
        at = int(words.end[a + e - 1]) - base
    out.append(data[at:])
    return b"".join(out).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
