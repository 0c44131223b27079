"""Nearest vectors through an inverted file with quantised residuals, rescored exactly.

``fit`` draws at most ``SAMPLE`` vectors (those of smallest key hash) to the driver and clusters them
there into ``lists`` centroids. The lists that a query visits are counted on the sample, too: as many as
hold ``TARGET`` of its members' nearest others, for how many that takes depends on how the vectors cluster. ``index`` assigns every row to its nearest centroid and stores
what is left of the vector in one byte for each dimension, in files by list. A query visits the
nearest lists; a list of many rows is cut into slices of ``SLICE``, each met by the list's
queries in a task of its own, so a vector that a third of the rows share does not make one
task. A slice returns its best ``POOL`` for each query by the quantised vectors; the best of all slices
are scored again with the stored vectors.

Vectors are compared by cosine, so they are brought to length one; null, empty, zero and non-finite ones, and those
whose length differs from the index's, are neither indexed nor asked for. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialise

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Rows of a list that one task compares.
SLICE = 20_000
#: Candidates of a query that are scored exactly.
POOL = 50
ROUNDS = 12
#: Share of the nearest in the sample that the visited lists hold, and the members that it is measured by.
TARGET, TRIED = 0.96, 1000


@dataclass(frozen=True)
class Quantiser:
    """Centroids of unit vectors, and the step of a residual's byte in each dimension."""

    centroids: np.ndarray
    step: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each unit vector, and its residual in bytes."""
        nearest = (x @ self.centroids.T).argmax(1)
        residual = np.rint((x - self.centroids[nearest]) / self.step)
        return nearest, np.clip(residual, -127, 127).astype(np.int8)


def unit(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column brought to length one, and the mask of the rows that have one of ``dims`` finite numbers."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dims = dims or int(lengths.max(initial=0))
    mask = (lengths == dims) & (lengths > 0)
    flat = column.filter(pa.array(mask)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dims) if dims else np.zeros((0, 0))
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    mask[np.flatnonzero(mask)[~good]] = False
    return (x[good] / norm[good, None]).astype(np.float32), mask


def fit(vectors: DataFrame, key: str, vector: str, lists: int | None = None) -> Quantiser | None:
    """Centroids of a bounded sample; by default as many as the square root of the rows, at most a thirtieth of the sample."""
    good = vectors.where(F.size(vector) > 0)
    total = good.count()
    top = good.select(key, F.col(vector).cast("array<double>").alias(vector)).orderBy(F.xxhash64(F.lit(1), key), key).limit(SAMPLE)
    sample = [r[vector] for r in top.select(vector).collect()]
    most = max(set(map(len, sample)), key=lambda n: sum(len(x) == n for x in sample)) if sample else 0
    x, _ = unit(pa.array(sample, pa.list_(pa.float64())), most) if most else (np.zeros((0, 0)), None)
    if not len(x):
        return None
    k = min(lists or int(np.sqrt(total)) + 1, max(1, len(x) // 30), len(x))
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    residual = np.abs(x - c[(x @ c.T).argmax(1)])
    step = np.maximum(np.quantile(residual, 0.999, axis=0) / 127, 1e-9)
    return Quantiser(c.astype(np.float32), step.astype(np.float32), _probes(x, c))


def _probes(x: np.ndarray, c: np.ndarray, n: int = 10) -> int:
    """Lists to visit so that ``TARGET`` of the n nearest others of the first members are met."""
    own = (x @ c.T).argmax(1)
    ranks = []
    for at in range(0, min(TRIED, len(x)), 100):
        some = x[at : at + 100]
        order = np.argsort(-(some @ c.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(some), 0), 1)
        near = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, : n + 1]
        ranks.append(np.take_along_axis(place, own[near], 1).ravel())
    return int(np.quantile(np.concatenate(ranks), TARGET, method="higher")) + 1


def index(vectors: DataFrame, key: str, vector: str, q: Quantiser) -> DataFrame:
    """key, list and code of every vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mask = unit(batch.column(1), q.dims)
            lists, codes = q.code(x)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), pa.array(lists, pa.int32()), packed], names=[key, "list", "code"])

    return vectors.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(work, f"{key} {dict(vectors.dtypes)[key]}, list int, code binary")


def search(indexed: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, q: Quantiser, n: int = 10, probes: int | None = None) -> DataFrame:
    """The n nearest of each query: query_key, key, score (cosine, at least 0)."""
    kind, query_kind = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mask = unit(batch.column(1), q.dims)
            near = np.argsort(-(x @ q.centroids.T), axis=1, kind="stable")[:, : probes or q.probes]
            take = np.repeat(np.flatnonzero(mask), near.shape[1])
            asked = pa.array([x[k].tobytes() for k in range(len(x))], pa.binary()).take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(near.ravel(), pa.int32()), asked], names=[query_key, "list", "asked"])

    # A row for each list: its slices.
    slices = indexed.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    aimed = queries.select(query_key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(aim, f"{query_key} {query_kind}, list int, asked binary")
    aimed = aimed.join(F.broadcast(slices), "list").select(query_key, "list", "asked", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    cut = indexed.join(F.broadcast(slices), "list").select(key, "list", "code", F.pmod(F.xxhash64(F.lit(2), key), F.col("slices")).cast("int").alias("slice"))
    schema = pa.schema([(query_key, pa.int64()), (key, pa.int64()), ("rough", pa.float64())])

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        c = q.centroids[rows.column("list")[0].as_py()]
        codes = np.frombuffer(b"".join(x.as_py() for x in rows.column("code")), np.int8).reshape(-1, q.dims)
        keys = rows.column(key).to_numpy()
        x = np.frombuffer(b"".join(v.as_py() for v in asked.column("asked")), np.float32).reshape(-1, q.dims)
        rough = (x * q.step) @ codes.T.astype(np.float32) + (x @ c)[:, None]
        best = np.argpartition(-rough, min(POOL, rough.shape[1]) - 1, axis=1)[:, :POOL]
        who = np.repeat(asked.column(query_key).to_numpy(), best.shape[1])
        return pa.table([pa.array(who), pa.array(keys[best].ravel()), pa.array(np.take_along_axis(rough, best, 1).ravel().astype(np.float64))], schema=schema)

    rough = cut.groupBy("list", "slice").cogroup(aimed.groupBy("list", "slice")).applyInArrow(compare, f"{query_key} {query_kind}, {key} {kind}, rough double")
    first = W.partitionBy(query_key).orderBy(F.desc("rough"), key)
    pool = materialise(rough.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= POOL).select(query_key, key), "pool")
    return _rescored(pool, vectors, queries, key, vector, query_key, n)


def _rescored(pool: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, n: int) -> DataFrame:
    x = vectors.select(key, F.col(vector).cast("array<double>").alias("_x"))
    y = queries.select(query_key, F.col(vector).cast("array<double>").alias("_y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("_x", "_y") / F.sqrt(dot("_x", "_x") * dot("_y", "_y"))
    scored = pool.join(x, key).join(y, query_key).select(query_key, key, F.greatest(F.lit(0.0), cosine).alias("score"))
    order = W.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
