"""N-gram Jaccard join: every link at similarity 0.75 or more, as components.

A document's set holds its distinct 5-word shingles (48-bit hashes). Two
documents link if 100 |A n B| >= 75 |A u B|. All links are honoured exactly,
without forming the pairs of a group:

1. *Document frequencies.* Chunks send their distinct shingles to buckets and
   get back in how many sets each stands, as a class of powers of two. Equal
   texts of a chunk are one set and link at once.
2. *Prefixes.* Shingles are ordered by (class, hash), rare ones first. A set of
   n shingles that links holds, among its first n - ceil(0.75 n) + 1, one that
   also is in its partner's first ones. A document all of whose prefix shingles
   stand nowhere else has no partner and drops out: most do.
3. *Stars.* Near copies share the smallest permuted shingle with probability of
   their similarity. Live documents with an equal smallest shingle, under each
   of ``ROUNDS`` permutations, are compared with one of them alone: the one with
   the fewest shingles of its own, which is nearest to what the group has in
   common. A group of any size costs one comparison a member, and verified
   links join most groups into one component.
4. *Size-banded tiles.* What is left are prefix shingles that documents of
   different components share. Entries are grouped by shingle and size band
   (sizes in ratio 3:4; a set meets its own band and the next). Within a tile,
   pairs of different components are compared by size and by the shingle's
   places in the two sets: at the first common shingle, what follows it bounds
   the overlap. A tile of many rows is cut into slices, and every two slices are
   compared in a task of their own. Survivors meet as hashed bitmap signatures: bits that differ
   bound the symmetric difference from below, so bit counts bound the overlap
   from above. Who passes is verified by exact intersection of the sorted arrays.

Pairs that are already in one component need no comparison: their link would
change no component. Every other pair that links shares a prefix shingle, so it
meets in a tile. Links become components by stars of edges.

Defined cases: null and empty texts, and texts without words, have an empty set
and link with nothing; fewer than five words are one shingle, the whole
sequence; a row without doc_id takes no part, its component is null; rows of one
doc_id are one node. Other columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm.components import components
from lodestone.session import materialise

SHINGLE = 5
#: Links: LINK_A * overlap >= LINK_B * union.
LINK_A, LINK_B = 100, 75
ROUNDS = 2
#: Bytes of a shingle where sets are compared.
TOKEN_BYTES = 6
#: Bits of a signature: a power of two from four for each element on, so that few differing elements hide.
BITMAP_PER_ITEM, BITMAP_MIN, BITMAP_MAX = 4, 64, 1 << 17
#: Rows of a tile that are compared with each other at a time.
BLOCK = 1024

SETS = "doc_id long, n long, lone long, same_as long, live boolean, k0 long, k1 long, tokens binary, prefix binary, places binary, bits binary"


def shingle_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by document: document index and hash, sorted by both, and the set sizes."""
    words = T.Words(*T.flat(table.column("text")), T.SPACED)
    hashes = words.hashes(lower=True)
    counts, n = words.counts, words.n_docs
    left = np.repeat(words.first[1:], counts) - np.arange(len(words))
    at = np.flatnonzero(left >= SHINGLE)
    docs, values = words.doc()[at], T.windows(hashes, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        extra = [T.windows(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] ^ T.mix(np.array([counts[i]], np.uint64))[0] for i in short.tolist()]
        docs, values = np.concatenate((docs, short)), np.concatenate((values, np.array(extra, np.uint64)))
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[new], values[new]
    return docs, values, np.bincount(docs, minlength=n)


def _first_of_equal(docs: np.ndarray, values: np.ndarray, sizes: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of the document with the smallest id among those with an equal set; itself if its set is empty."""
    n = len(sizes)
    out = np.arange(n)
    some = np.flatnonzero((sizes > 0) & known)
    if not len(docs):
        return out
    starts = np.searchsorted(docs, np.arange(n))
    sums = np.zeros((2, n), np.uint64)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(values ^ np.uint64(salt)))))
        sums[k] = total[starts + sizes] - total[starts]
    order = some[np.lexsort((ids[some], sizes[some], sums[1][some], sums[0][some]))]
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (sums[0][a] != sums[0][b]) | (sums[1][a] != sums[1][b]) | (sizes[a] != sizes[b])
    out[order] = order[new][np.cumsum(new) - 1]
    return out


class _Sets:
    """The distinct sets of a chunk: one document of each group of equal sets."""

    def __init__(self, table: pa.Table, bits: int):
        self.docs, self.values, self.sizes = shingle_sets(table)
        self.ids, self.known = C.doc_ids(table)
        self.first = _first_of_equal(self.docs, self.values, self.sizes, self.ids, self.known)
        own = (self.first == np.arange(len(self.sizes))) & self.known
        keep = own[self.docs]
        self.docs, self.values = self.docs[keep], self.values[keep]
        self.keys, self.key_of, self.counts = np.unique(C.narrow_keys(self.values, bits), return_inverse=True, return_counts=True)


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """0 for one set, then one class for each power of two, 15 at most."""
    return np.minimum(15, np.ceil(np.log2(np.maximum(df, 1))).astype(np.int64)).astype(np.uint8)


def _classes(bucket: int, rows: list[dict]):
    """Frequency class of each chunk's keys; chunks whose keys all stand once get no reply."""
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
    counts = np.concatenate([C.unsqueeze(r["extra"], np.uint16, r["n"]) for r in rows])
    _, inverse = np.unique(keys, return_inverse=True)
    df = np.bincount(inverse, weights=counts)[inverse]
    for r, part in zip(rows, np.split(_frequency_class(df), np.cumsum(sizes)[:-1])):
        if part.any():
            yield r["chunk"], r["n"], C.squeeze(part)


def _short(values: np.ndarray) -> bytes:
    """Leading bytes of sorted hashes, most significant first."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _long(data: bytes | None) -> np.ndarray:
    data = data or b""
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, 8 - TOKEN_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.reshape(-1).view(">u8").astype(np.int64)


def _bitmap(values: np.ndarray) -> bytes:
    """Hashed bitmap signature."""
    width = min(BITMAP_MAX, max(BITMAP_MIN, 1 << (BITMAP_PER_ITEM * len(values)).bit_length()))
    bits = np.zeros(width, bool)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(data: bytes, width: int) -> np.ndarray:
    """A bitmap folded to a smaller width, as 64-bit words."""
    words = np.frombuffer(data, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


def links(n_a, n_b, overlap):
    return LINK_A * overlap >= LINK_B * (n_a + n_b - overlap)


def sets_of(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Set size of every document; for live ones their star keys, shared shingles, shared prefix and bitmap."""
    spark = docs.sparkSession
    parts, bits = C.partitions(spark), C.bucket_bits(spark)
    chunks = C.pack(docs, parts, chunk_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = _Sets(C.load(payload.as_py()), bits)
                count = np.minimum(s.counts, 65535).astype(np.uint16)
                yield from C.asks(chunk, bits, s.keys, True, lambda x: C.squeeze(count[x])).to_batches()

    def finish(chunk: int, table: pa.Table, replies: dict) -> pa.Table:
        s = _Sets(table, bits)
        edges = np.searchsorted((s.keys >> np.uint64(32)).astype(np.int64), np.arange((1 << bits) + 1))
        classes = np.zeros(len(s.keys), np.uint8)
        for b, (n, reply) in replies.items():
            classes[edges[b] : edges[b] + n] = C.unsqueeze(reply, np.uint8, n)
        cls = classes[s.key_of]
        n_docs = table.num_rows
        starts = np.searchsorted(s.docs, np.arange(n_docs + 1))
        sizes = np.diff(starts)
        order = np.lexsort((s.values, cls, s.docs))
        place = np.arange(len(order)) - np.repeat(starts[:-1], sizes)
        length = sizes - (-(-LINK_B * sizes // LINK_A)) + 1
        place_of = np.empty(len(order), np.int32)
        place_of[order] = place
        in_prefix = np.zeros(len(order), bool)
        in_prefix[order[place < np.repeat(length, sizes)]] = True
        shared = cls > 0
        live = np.zeros(n_docs, bool)
        live[s.docs[in_prefix & shared]] = True
        keys = [T.mix(s.values ^ np.uint64(salt)) for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5)]
        columns: dict[str, list] = {k: [] for k in ("k0", "k1", "tokens", "prefix", "places", "bits")}
        for i in range(n_docs):
            if not live[i]:
                for c in columns.values():
                    c.append(None)
                continue
            mine = slice(starts[i], starts[i + 1])
            both = shared[mine]
            for k, name in enumerate(("k0", "k1")):
                columns[name].append(int(keys[k][mine][both].min().view(np.int64)))
            columns["tokens"].append(_short(s.values[mine][both]))
            columns["prefix"].append(_short(s.values[mine][both & in_prefix[mine]]))
            columns["places"].append(place_of[mine][both & in_prefix[mine]].tobytes())
            columns["bits"].append(_bitmap(s.values[mine]))
        lone = sizes - np.bincount(s.docs[shared], minlength=n_docs)
        same = s.first != np.arange(n_docs)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n": pa.array(s.sizes.astype(np.int64)),
                "lone": pa.array(lone.astype(np.int64)),
                "same_as": pa.array(s.ids[s.first], mask=~same),
                "live": pa.array(live),
                "k0": pa.array(columns["k0"], pa.int64()),
                "k1": pa.array(columns["k1"], pa.int64()),
                "tokens": pa.array(columns["tokens"], pa.binary()),
                "prefix": pa.array(columns["prefix"], pa.binary()),
                "places": pa.array(columns["places"], pa.binary()),
                "bits": pa.array(columns["bits"], pa.binary()),
            }
        )

    replies = C.answer(chunks.mapInArrow(ask, C.ASK_SCHEMA), parts, _classes)
    return C.meet(chunks, replies, parts, finish, SETS)


def verify(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by bitmaps and then exact intersection."""
    side = live.select("doc_id", "n", "tokens", "bits")
    left = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    both = pairs.join(left, F.col("a") == F.col("a_doc_id")).join(right, F.col("b") == F.col("b_doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            memo: tuple = (None, None)
            for a, b, n_a, n_b, t_a, t_b, m_a, m_b in zip(*(batch.column(k).to_pylist() for k in range(8))):
                width = 8 * min(len(m_a), len(m_b))
                differ = int(np.bitwise_count(_fold(m_a, width) ^ _fold(m_b, width)).sum())
                if not links(n_a, n_b, (n_a + n_b - differ) // 2):
                    continue
                if memo[0] != b:
                    memo = (b, _long(t_b))
                x, y = _long(t_a), memo[1]
                if len(x) and len(y):
                    overlap = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if links(n_a, n_b, overlap):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    cols = both.select("a", "b", "a_n", "b_n", "a_tokens", "b_tokens", "a_bits", "b_bits")
    return cols.mapInArrow(work, "a long, b long")


def star_pairs(live: DataFrame) -> DataFrame:
    """Each live document with the most common of those that share a permuted smallest shingle."""
    out = None
    for k in range(ROUNDS):
        key = live.select("doc_id", "n", "lone", F.col(f"k{k}").alias("k"))
        hub = key.groupBy("k").agg(F.min(F.struct("lone", "doc_id", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
        found = key.join(hub, "k").where(F.col("doc_id") != F.col("hub.doc_id"))
        found = found.where((LINK_A * F.col("n") >= LINK_B * F.col("hub.n")) & (LINK_A * F.col("hub.n") >= LINK_B * F.col("n")))
        found = found.select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _band() -> F.Column:
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(LINK_A / LINK_B)) + 1e-9).cast("int")


def tile_pairs(live: DataFrame, part_of: DataFrame, parts: int) -> DataFrame:
    """Pairs of different components that share a prefix shingle and may link by sizes and places."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, comp, prefix, places = (batch.column(k).to_pylist() for k in range(5))
            lists = [_long(p) for p in prefix]
            sizes = [len(x) for x in lists]
            if sum(sizes):
                flat = np.concatenate(lists)
                place = np.frombuffer(b"".join(p or b"" for p in places), np.int32)
                cols = [np.repeat(np.array(x, np.int64), sizes) for x in (doc, n, comp)]
                yield pa.RecordBatch.from_arrays([pa.array(flat), *map(pa.array, cols), pa.array(place)], names=["token", "doc_id", "n", "component", "place"])

    known = live.join(part_of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    listed = known.select("doc_id", "n", "component", "prefix", "places").mapInArrow(entries, "token long, doc_id long, n long, component long, place int")
    listed = materialise(listed, "prefixes")
    split = listed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    home = listed.join(split, "token").withColumn("band", _band()).withColumn("home", F.lit(True))
    guest = home.withColumn("band", F.col("band") + 1).withColumn("home", F.lit(False))
    rows = _sliced(home.unionByName(guest)).select("token", "band", "a", "b", "side", "home", "doc_id", "n", "component", "place")
    rows = rows.repartition(parts, "token", "band", "a", "b").sortWithinPartitions("token", "band", "a", "b", "n")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            yield from _tile_pairs(tile)

    return rows.mapInArrow(tiles, "a long, b long").distinct()


def _sliced(rows: DataFrame) -> DataFrame:
    """Rows with the part of their tile: slices a and b, and the row's own slice ``side``.

    A tile of more than ``BLOCK`` rows is dealt to slices by document; every two
    slices, and each with itself, are a tile of their own. So every pair still
    meets once, and no task holds a frequent shingle's rows.
    """
    large = rows.groupBy("token", "band").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK)
    slices = F.coalesce(F.ceil(F.col("many") / F.lit(BLOCK)).cast("int"), F.lit(1))
    rows = rows.join(large, ["token", "band"], "left").withColumn("slices", slices).drop("many")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("doc_id"), "slices").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return rows.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one (token, band, a, b) each, after these; tiles of one row or component are passed over."""
    kept: list[list[np.ndarray]] = []
    now = None

    def whole() -> Iterator[list[np.ndarray]]:
        tile = [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*kept)]
        one_side = now[2] != now[3] and tile[0].min() == tile[0].max()
        if len(tile[0]) > 1 and tile[4].min() != tile[4].max() and not one_side:
            yield tile

    for batch in batches:
        token, band, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        first, second, *rest = rest
        key = (token, band, first, second)
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if a == b:
                continue
            here = tuple(int(c[a]) for c in key)
            if here != now and kept:
                yield from whole()
                kept = []
            now = here
            kept.append([c[a:b] for c in rest])
    if kept:
        yield from whole()


def _tile_pairs(tile: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Survivors of a tile, block by block of rows in order of size."""
    side, home, doc, n, comp, place = tile
    after = n - place
    # Of two slices, only rows of different ones meet; each has a tile of its own.
    apart = side.min() != side.max()
    for i in range(0, len(doc), BLOCK):
        a = slice(i, i + BLOCK)
        for j in range(i, len(doc), BLOCK):
            b = slice(j, j + BLOCK)
            if LINK_A * n[a].max() < LINK_B * n[b].min():
                break
            may = (comp[a][:, None] != comp[b][None, :]) & (home[a][:, None] | home[b][None, :])
            # The shingles from here on bound the overlap, and so does the smaller set.
            may &= links(n[a][:, None], n[b][None, :], np.minimum(after[a][:, None], after[b][None, :]))
            if apart:
                may &= side[a][:, None] != side[b][None, :]
            if i == j:
                may &= np.arange(may.shape[0])[:, None] < np.arange(may.shape[1])[None, :]
            x, y = np.nonzero(may)
            p, q = doc[a][x], doc[b][y]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["a", "b"])


def join(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    sets = materialise(sets_of(docs, chunk_bytes), "sets")
    live = sets.where("live")
    copies = sets.where("same_as is not null").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b"))
    stars = materialise(verify(star_pairs(live), live), "stars")
    near = components(copies.unionByName(stars))
    tiled = materialise(verify(tile_pairs(live, near, C.partitions(spark)), live), "tiled")
    # The components so far are stars already; only the new links are added.
    so_far = near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    part_of = components(so_far.unionByName(tiled)) if tiled.head(1) else near
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(part_of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component; rows without an id stay.

    Of rows with one doc_id that is the first, all stay.
    """
    drop = join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
