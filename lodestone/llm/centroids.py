"""Centroid clustering of integer vectors with partial-distance search.

Squared differences are summed over the dimensions of highest variance first.
The centroid that leads after the first block of dimensions is finished at once,
so every vector has a distance to beat; then, block by block, a centroid is
abandoned for a vector as soon as its partial sum is strictly above that
distance. What is left after the last block has all dimensions summed. An
abandoned centroid is strictly farther, so the nearest one and its ties are
those of a full search. The order of dimensions changes the work only.

Everything is done in 64-bit integers. A task sums its vectors by centroid
before anything is shuffled, so a round moves (centroids x dimensions) numbers
from each task and brings as many to the driver, whatever the number of vectors;
a vector that stands in a third of the rows is one more term of a sum.

Defined cases. A vector is kept if it is not null and has ``dims`` components,
none null or non-finite. A component whose scaled value is beyond 2**27 in
magnitude is outside of what 64 bits can hold exactly and its vector is left out
like a non-finite one. Rows with equal vec_id are vectors of their own; null ids
come after all others in the draw of the first centroids, ties there go by the
components. Fewer vectors than centroids: as many centroids as vectors; none:
no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

#: Largest scaled component: 64 squared differences of twice this stay below 2**63.
LARGEST = 1 << 27
#: Dimensions summed between two looks at who may be abandoned.
BLOCK = 8
#: Vectors compared at a time.
ROWS = 2048


@dataclass(frozen=True)
class Settings:
    """``dims`` up to 64; ``scale`` multiplies a component before it is floored; ``salt`` draws the first centroids."""

    clusters: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    salt: int = 2


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled integer vectors of the rows that are kept, and the mask of those rows."""
    n = len(column)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kept = lengths == dims
    rows = column.filter(pa.array(kept))
    flat = rows.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * scale)
        whole = np.all(np.abs(scaled) <= LARGEST, axis=1)  # NaN, which a null is too, compares false
    mask = np.zeros(n, bool)
    mask[np.flatnonzero(kept)[whole]] = True
    return scaled[whole].astype(np.int64), mask


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller) and the squared distance."""
    out = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    c = np.ascontiguousarray(centroids[:, order])
    for at in range(0, len(vectors), ROWS):
        some = slice(at, at + ROWS)
        out[0][some], out[1][some] = _nearest(np.ascontiguousarray(vectors[some][:, order]), c)
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dims = x.shape
    partial = np.zeros((n, len(c)), np.int64)
    for j in range(min(BLOCK, dims)):
        d = x[:, j, None] - c[None, :, j]
        partial += d * d
    lead = partial.argmin(1)
    best = _squares(x, c[lead])
    row, centroid = np.nonzero(partial <= best[:, None])
    total = partial[row, centroid]
    for j in range(BLOCK, dims, BLOCK):
        total = total + _squares(x[row, j : j + BLOCK], c[centroid, j : j + BLOCK])
        alive = total <= best[row]
        row, centroid, total = row[alive], centroid[alive], total[alive]
    # The leader is always left; of a vector's rest, the least distance comes first, then the smaller number.
    first = np.lexsort((centroid, total, row))
    row, centroid, total = row[first], centroid[first], total[first]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    return centroid[start], total[start]


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _first(vectors: DataFrame, s: Settings) -> np.ndarray:
    """The kept vectors with the smallest hashes of their ids: a top-k of ``clusters`` rows."""
    e = F.col("embedding")
    scaled = F.transform(e, lambda x: x * F.lit(float(s.scale)))
    kept = vectors.where((F.size(e) == s.dims) & F.forall(scaled, lambda x: F.coalesce((x >= -LARGEST) & (x < LARGEST + 1), F.lit(False))))  # NaN is above all numbers
    draw = F.sha2(F.concat(F.lit(f"{s.salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = kept.select(draw.alias("draw"), e).orderBy(F.col("draw").asc_nulls_last(), "embedding").limit(s.clusters).collect()
    found, mask = integers(pa.array([r["embedding"] for r in top], pa.list_(pa.float64())), s.dims, s.scale)
    assert mask.all()
    return found


def _spread_of(vectors: DataFrame, s: Settings) -> np.ndarray:
    """Dimensions by falling variance over all kept vectors; only the work depends on it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(s.dims), np.zeros(s.dims)
        for batch in batches:
            x, _ = integers(batch.column(1), s.dims, s.scale)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x.astype(np.float64) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.dims), pa.int32()), pa.array(np.full(s.dims, n)), pa.array(sums), pa.array(squares)], names=["dim", "n", "s", "q"])

    got = vectors.mapInArrow(work, "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    variance = np.zeros(s.dims)
    for r in got:
        variance[r["dim"]] = r["q"] / max(r["n"], 1) - (r["s"] / max(r["n"], 1)) ** 2
    return np.argsort(-variance, kind="stable")


def _round(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, s: Settings) -> np.ndarray:
    """Centroids moved to the floored means of their vectors; one without vectors stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x, _ = integers(batch.column(1), s.dims, s.scale)
            k, _ = nearest(x, centroids, order)
            n += np.bincount(k, minlength=len(centroids))
            by = np.argsort(k, kind="stable")
            there, start = np.unique(k[by], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(x[by], start, axis=0)
        there = np.flatnonzero(n)
        cluster, dim = np.repeat(there, s.dims), np.tile(np.arange(s.dims), len(there))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(n[cluster]), pa.array(sums[there].ravel())], names=["cluster", "dim", "n", "s"])

    parts = vectors.mapInArrow(work, "cluster int, dim int, n long, s long")
    # Sums of many tasks may pass 64 bits; there are clusters x dims of them.
    whole = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    moved = centroids.copy()
    for r in whole:
        moved[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return moved


def fit(rows: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after all rounds, and the order of dimensions in which they are compared."""
    vectors = _vectors(rows)
    centroids = _first(vectors, s)
    order = np.arange(s.dims)
    if len(centroids):
        order = _spread_of(vectors, s)
        for _ in range(s.rounds):
            centroids = _round(vectors, centroids, order, s)
    return centroids, order


ASSIGNED = "vec_id long, cluster int, distance long"


def assign(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """The nearest of ``centroids`` for each kept vector, and the squared distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mask = integers(batch.column(1), s.dims, s.scale)
            k, d = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), pa.array(k, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    vectors = _vectors(rows)
    return vectors.mapInArrow(work, ASSIGNED) if len(centroids) else vectors.sparkSession.createDataFrame([], ASSIGNED)


def cluster(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each kept vector's cluster and distance, the sums of distances of its cluster and of all, and a digest of its centroid."""
    centroids, order = fit(rows, s)
    found = materialise(assign(rows, centroids, order, s), "clusters")
    # One row for each cluster.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = [(r["cluster"], r["cluster_inertia"], inertia, digest[r["cluster"]]) for r in sums]
    of = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
