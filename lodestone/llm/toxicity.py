"""Toxicity by compression distance to separately trained dictionaries.

A text is cut into windows of ``WINDOW`` words. ``PAIRS`` pairs of zstandard
dictionaries are trained: in each pair one on windows of toxic documents and one
on windows of ordinary documents, each on a half of its class's windows that is
drawn anew for the pair. A window is compressed with every dictionary, and its
*lean* is the bytes that the ordinary dictionaries need more than the toxic ones,
summed over the pairs. What one dictionary holds by chance of the words that both
classes share goes up and down from pair to pair and cancels; what only toxic
text says is in every toxic dictionary and adds up.

Thresholds are calibrated on labelled documents that trained no dictionary: they
are the leans that given shares of ordinary windows stay below. A document's
leans (largest, mean of the three largest, mean, and the shares of windows that
reach each threshold) become a probability by a logistic calibration on the same
documents, weighted to the labels' true shares.

Bounds: the model learns from at most ``MAX_TOXIC`` toxic and ``MAX_ORDINARY``
other labelled rows in each of the two roles, in order of a hash of the id,
whatever their length. Dictionaries are trained on at most ``MAX_WINDOWS``
distinct windows of a class, in order of a hash, each of ``WINDOW_BYTES`` at
most (a longer one is cut into several). They are trained on the executors; the
driver sees dictionaries of a fixed size and, for each calibrating document, how
often each lean occurs. The label shares are counted over all labels. Every text
is scored whole.

Defined cases: null and empty texts have one empty window of lean 0; an id with
both labels, or with labels other than 0 and 1, is not learned from; without
labelled rows of both classes in both roles every score is the share of toxic
labels (0 without any); null ids are scored, never learned from, and not held
out; repeated labels count once; of repeated documents each is learned from.
Inputs of a score are the text's bytes alone.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C

FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
WINDOW, WINDOW_BYTES = 8, 256
PAIRS = 5
LEVEL = 3
#: Bytes of an ordinary and of a toxic dictionary, and the lengths of their segments and of what is counted in them.
SIZES, SEGMENT, GRAM = (1 << 15, 1 << 14), 10, 8
MAX_TOXIC, MAX_ORDINARY, MAX_WINDOWS = 3000, 6000, 100_000
#: Bytes of text whose windows are compressed together.
BATCH_BYTES = 1 << 20
#: Shares of ordinary windows below the thresholds.
BELOW = (0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
THRESHOLD = 0.3

SCORED = "doc_id long, score double"


def windows(text: str | None) -> list[bytes]:
    """Windows in order; one empty window if there are no words."""
    words = (text or "").encode().lower().split()
    whole = [b" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)] or [b""]
    return [w[k : k + WINDOW_BYTES] for w in whole for k in range(0, max(1, len(w)), WINDOW_BYTES)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


class Leans:
    """Compressors of the pairs of (ordinary, toxic) dictionaries."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...]):
        self.pairs = [(self._compress(a), self._compress(b)) for a, b in pairs]

    @staticmethod
    def _compress(content: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(**options)
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=raw, **options)

    @staticmethod
    def _sizes(compressor: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
        made = compressor.multi_compress_to_buffer(parts, threads=1)
        return np.fromiter((len(made[k]) for k in range(len(parts))), np.int64, len(parts))

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the ordinary dictionaries need more, over all pairs, by window; 0 for an empty one."""
        out = np.zeros(len(parts), np.int64)
        some = [x for x in parts if x]
        if some:
            full = np.fromiter(map(bool, parts), bool, len(parts))
            out[full] = sum(self._sizes(ordinary, some) - self._sizes(toxic, some) for ordinary, toxic in self.pairs)
        return out

    def of_texts(self, texts: pa.ChunkedArray) -> list[np.ndarray]:
        """Leans of each text; one compressor after the other sees the windows of all texts, which keeps its tables near."""
        parts = [windows(t.as_py()) for t in texts]
        leans = self([w for x in parts for w in x])
        return np.split(leans, np.cumsum([len(x) for x in parts])[:-1])


def features(leans: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """Largest, mean of the three largest, mean, shares that reach the thresholds."""
    top = np.sort(leans)[::-1][:3]
    return np.array([top[0], top.mean(), leans.mean(), *((leans >= t).mean() for t in thresholds)])


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; ``prior`` is the score where there is no calibration."""

    pairs: tuple[tuple[bytes, bytes], ...]
    thresholds: tuple[int, ...]
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    prior: float

    def probability(self, leans: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        z = (features(leans, self.thresholds) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, self.weights[0] + z @ self.weights[1:])))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression with a ridge, by Newton steps: mean, scale, weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = z.T @ (weight * (p - y)) + np.append(0.0, w[1:])
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(np.append(1e-9, np.ones(len(w) - 1)))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def calibrate(pairs: tuple[tuple[bytes, bytes], ...], found: list[tuple[int, list[int], list[int]]], prior: float) -> Model:
    """Model from (toxic, leans, their counts) of the calibrating documents; each class weighs as among all labels."""
    y = np.array([t for t, _, _ in found], np.float64)
    if not pairs or not 0 < y.sum() < len(y):
        return Model((), (), None, None, None, prior)
    leans = [np.repeat(np.array(v, np.int64), n) for _, v, n in found]
    ordinary = np.concatenate([x for x, t in zip(leans, y) if not t])
    thresholds = tuple(sorted({int(v) for v in np.quantile(ordinary, BELOW, method="higher")}))
    x = np.array([features(v, thresholds) for v in leans])
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    return Model(pairs, thresholds, *logistic(x, y, weight), prior)


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the ids whose labels agree."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).where("toxic = __most and toxic in (0, 1)").drop("__most")


def _chosen(known: DataFrame) -> list[tuple[int, int, bool]]:
    """Bounded pick of (id, toxic, calibrates)."""
    picks = []
    for toxic, limit in ((0, MAX_ORDINARY), (1, MAX_TOXIC)):
        for role in (False, True):
            mine = known.where((F.col("toxic") == toxic) & (F.col("calibrates") == role))
            picks += [tuple(r) for r in mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]
    return picks


def _train(texts: DataFrame) -> tuple[tuple[bytes, bytes], ...]:
    """Pairs of dictionaries from (toxic, text) rows; each is trained by one executor task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = sorted(set(windows(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["toxic", "part"])

    def train(key: tuple, table: pa.Table) -> pa.Table:
        # A fixed random order: the trainer picks its segments stretch by stretch of the samples.
        samples = sorted(table.column("part").to_pylist())
        random.Random(key[0].as_py()).shuffle(samples)
        made = dictionary(samples, SIZES[key[1].as_py()])
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "toxic": pa.array([key[1].as_py()], pa.int32()), "made": pa.array([made], pa.binary())})

    parts = texts.mapInArrow(cut, "toxic int, part binary").where("length(part) > 0").distinct()
    half = F.array(*[F.when(F.xxhash64("part", F.lit(p)) >= 0, F.lit(p)) for p in range(PAIRS)])
    sample = None
    for toxic in (0, 1):
        mine = parts.where(F.col("toxic") == toxic).orderBy(F.xxhash64("part"), "part").limit(MAX_WINDOWS)
        sample = mine if sample is None else sample.unionByName(mine)
    dealt = sample.select("toxic", "part", F.explode(F.array_compact(half)).alias("pair"))
    # A number of partitions of its own, so that the few rows are not put into one task.
    rows = dealt.repartition(4 * PAIRS, "pair", "toxic").groupBy("pair", "toxic").applyInArrow(train, "pair int, toxic int, made binary").collect()
    made = {(r["pair"], r["toxic"]): bytes(r["made"]) for r in rows}
    return tuple((made.get((p, 0), b""), made.get((p, 1), b"")) for p in range(PAIRS))


def _lean_counts(texts: DataFrame, pairs: tuple[tuple[bytes, bytes], ...]) -> list[tuple[int, list[int], list[int]]]:
    """(toxic, distinct leans, their counts) of each (toxic, text) row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean = Leans(pairs)
        for table in C.bounded(batches, BATCH_BYTES):
            counted = [np.unique(x, return_counts=True) for x in lean.of_texts(table.column("text"))]
            leans, counts = (pa.array([c[k].tolist() for c in counted], pa.list_(pa.int64())) for k in (0, 1))
            yield from pa.table({"toxic": table.column("toxic"), "leans": leans, "counts": counts}).to_batches()

    rows = texts.mapInArrow(work, "toxic int, leans array<long>, counts array<long>").collect()
    return sorted((r["toxic"], list(r["leans"]), list(r["counts"])) for r in rows)


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Train on labelled rows outside the held-out fold."""
    C.tune(docs.sparkSession)
    known = known_labels(labels).where(remainder(F.col("doc_id"), folds) != held_out)
    known = known.withColumn("calibrates", remainder(F.col("doc_id"), folds) == CALIBRATE)
    counts = dict(known.groupBy("toxic").count().collect())
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
    picks = _chosen(known)
    if {(t, c) for _, t, c in picks} != {(t, c) for t in (0, 1) for c in (False, True)}:
        return calibrate((), [], prior)
    # At most 2 * (MAX_TOXIC + MAX_ORDINARY) ids.
    chosen = docs.sparkSession.createDataFrame(picks, "doc_id long, toxic int, calibrates boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    pairs = _train(texts.where("not calibrates").select("toxic", "text"))
    return calibrate(pairs, _lean_counts(texts.where("calibrates").select("toxic", "text"), pairs), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    C.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean = Leans(shared.value.pairs)
        for table in C.bounded(batches, BATCH_BYTES):
            scores = [shared.value.probability(x) for x in lean.of_texts(table.column("text"))]
            yield from pa.table({"doc_id": table.column("doc_id"), "score": pa.array(scores, pa.float64())}).to_batches()

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(work, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = score(docs, learn(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
