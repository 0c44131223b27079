"""Chunk exchange: statistics over all documents with each text moved once.

Documents are packed into *chunks*: one row holds the ids and texts of a few
megabytes of consecutive documents as a compressed Arrow stream. A chunk asks
questions about hashes ("does this window also occur elsewhere?"); each hash
belongs to a *bucket*, a bucket's task answers for every chunk at once, and the
answers return to the chunk. Because a chunk sends each distinct hash once, a
hash that stands in a third of all rows costs one entry per chunk, and because
answers travel to chunks and not to documents, no task ever holds the group of
rows that share a value.

The number of buckets follows ``spark.sql.shuffle.partitions``, the setting by
which a cluster is sized to its input; a bucket is processed on its own, so a
task's memory is a bucket, not a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk, the last document excepted.
CHUNK_BYTES = 4 << 20
#: Rows in an Arrow batch; bounds a batch's bytes where texts are long.
BATCH_ROWS = 512

CHUNK_SCHEMA = "chunk long, payload binary"
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system; a reused worker otherwise holds on to its largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def bounded(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches of (…, text) into tables of about ``limit`` bytes of text."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index("text"))
        lengths = np.zeros(batch.num_rows, np.int64)
        if len(texts) != texts.null_count:
            lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = int(np.searchsorted(ends, done + limit - size)) + 1
            stop = min(max(stop, begin + 1), batch.num_rows)
            kept.append(batch.slice(begin, stop - begin))
            size += int(ends[stop - 1] - done)
            begin = stop
            if size >= limit:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)
    kept = []
    give_back()


def pack(docs: DataFrame, partitions: int, chunk_bytes: int = CHUNK_BYTES, whole: bool = False) -> DataFrame:
    """Chunks of ``docs`` (doc_id and text, or ``whole`` rows), dealt by chunk number.

    The number is made of the task's partition and a counter, so a repeated
    task makes the same chunks again.
    """
    tune(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, table in enumerate(bounded(batches, chunk_bytes)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([dump(table)], pa.binary())], names=["chunk", "payload"]
            )

    cols = docs if whole else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(make, CHUNK_SCHEMA).repartition(partitions, "chunk")


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def doc_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a mask of the rows that have one."""
    ids = table.column("doc_id").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
    ids = ids.cast(pa.int64())
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), known


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(spark: SparkSession) -> int:
    """Buckets as a power of two, several to a partition."""
    return min(20, max(6, (4 * partitions(spark) - 1).bit_length()))


def squeeze(data: np.ndarray) -> bytes:
    """Array to bytes, compressed."""
    return pa.compress(data.tobytes(), codec="zstd", asbytes=True) if data.nbytes else b""


def unsqueeze(data: bytes, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(data, decompressed_size=n * dtype.itemsize, codec="zstd"), dtype)


ASK_SCHEMA = "bucket int, chunk long, n int, keys binary, extra binary"
REPLY_SCHEMA = "chunk long, bucket int, n int, reply binary"


def asks(chunk: int, bits: int, keys: np.ndarray, narrow: bool, extra: Callable[[slice], bytes] | None = None, every: bool = False, shift_key: np.ndarray | None = None) -> pa.Table:
    """Rows that carry sorted distinct ``keys`` to their buckets.

    ``narrow`` keys are the top ``bits + 32`` bits of a hash: a bucket's key is
    32 bits wide. Such keys may collide, so use them only where a false match
    costs work and not a wrong result. Other keys keep all 64 bits;
    ``shift_key`` then gives the bucket's bits from a second hash.
    ``every`` sends a row to empty buckets too.
    """
    n_buckets = 1 << bits
    if narrow:
        of = (keys >> np.uint64(32)).astype(np.int64)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    else:
        of = (keys >> np.uint64(64 - bits)).astype(np.int64) if shift_key is None else shift_key
        low = keys
    edges = np.searchsorted(of, np.arange(n_buckets + 1))
    used = range(n_buckets) if every else np.flatnonzero(np.diff(edges))
    rows = [(int(b), slice(int(edges[b]), int(edges[b + 1]))) for b in used]
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in rows], pa.int32()),
            "chunk": pa.array([chunk] * len(rows), pa.int64()),
            "n": pa.array([s.stop - s.start for _, s in rows], pa.int32()),
            "keys": pa.array([low[s].tobytes() for _, s in rows], pa.binary()),
            "extra": pa.array([extra(s) if extra else None for _, s in rows], pa.binary()),
        }
    )


def narrow_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(32 - bits)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time from a partition sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if rows:
                    yield now, rows
                now, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield now, rows
    rows = []
    give_back()


def answer(asked: DataFrame, parts: int, fn: Callable[[int, list[dict]], Iterator[tuple[int, int, bytes]]], schema: str = REPLY_SCHEMA) -> DataFrame:
    """Run ``fn(bucket, rows)`` over each bucket; it yields (chunk, n, reply)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            got = list(fn(bucket, rows))
            if got:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c for c, _, _ in got], pa.int64()),
                        pa.array([bucket] * len(got), pa.int32()),
                        pa.array([n for _, n, _ in got], pa.int32()),
                        pa.array([r for _, _, r in got], pa.binary()),
                    ],
                    names=["chunk", "bucket", "n", "reply"],
                )

    dealt = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(work, schema)


def meet(chunks: DataFrame, replies: DataFrame, parts: int, fn: Callable[[int, pa.Table, dict[int, tuple[int, bytes]]], pa.Table | None], schema, dealt: bool = False) -> DataFrame:
    """Bring each chunk together with its replies: ``fn(chunk, docs, replies)``; ``dealt`` ones are by chunk already."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    empty = to_arrow_schema(fields).empty_table()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        answers = {r["bucket"]: (r["n"], r["reply"]) for r in right.to_pylist()}
        out = fn(left.column("chunk")[0].as_py(), load(left.column("payload")[0].as_py()), answers)
        give_back()
        return empty if out is None else out

    right = replies if dealt else replies.repartition(parts, "chunk")
    return chunks.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(work, schema)
