"""The k best documents of each query, without scoring every document that shares a token.

A score is a sum over tokens of *weight* (of the query: occurrences times inverse
document frequency) times *impact* (of the document: the saturated, length-normalised
frequency). Impacts do not depend on queries, so they are stored once, in *blocks* of a few
documents of about the same length, for length decides how large an impact can be, with
the largest impact of each token in each block.

A query is answered in four joins:

1. documents with its rarest tokens are scored; the k-th best score is a threshold
   that no document of the answer falls below;
2. in each block the query's tokens are ordered by the most that one can add for each posting
   that it has there. Those at the front whose sum stays below the threshold are *optional*:
   a document of the block with only such tokens cannot be among the best. Postings of the
   other tokens give the candidates, with a partial score; a block whose tokens are all optional is not read;
3. a candidate stays if its partial score and the most that the optional tokens can add
   in its block reach the threshold, which has risen to the k-th best partial score if that is more;
4. what is left is scored by all tokens.

The answer is that of full scoring. Long posting lists belong to common tokens, which
are optional as a rule, and are then read only for the documents that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialise

#: Classes of length to a doubling, and documents of a block within a class, about.
CLASSES_PER_OCTAVE = 4
BLOCK_DOCS = 8
#: Documents scored for the threshold, as a multiple of k.
SEEDS = 10
#: Scores are ranked at six decimals, so a document this close below the threshold may still tie.
MARGIN = 2e-6
#: Rows of a side that is sent to all tasks at most; a larger one is joined by a shuffle.
MOST_SENT = 200_000


def impacts(rows: DataFrame, key: str, k1: float, b: float, frequency: str = "tf") -> DataFrame:
    """key, token, impact and block, from postings (key, token, tf, and ``frequency`` if another is to be saturated)."""
    lengths = rows.groupBy(key).agg(F.sum("tf").alias("_len"))
    mean = rows.agg((F.sum("tf") / F.countDistinct(key)).alias("_mean"))  # one row
    norm = F.lit(1 - b) + F.lit(b) * F.col("_len") / F.col("_mean")
    f = F.col(frequency)
    kind = F.floor(F.log2(F.col("_len").cast("double")) * CLASSES_PER_OCTAVE)
    lengths = lengths.withColumn("_kind", kind)
    sizes = lengths.groupBy("_kind").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("_blocks"))  # a hundred rows or so: a length has so many doublings
    block = F.shiftleft(F.col("_kind"), 48) + F.pmod(F.xxhash64(key), F.col("_blocks"))
    lengths = lengths.join(F.broadcast(sizes), "_kind").select(key, "_len", block.alias("block"))
    return rows.join(lengths, key).crossJoin(F.broadcast(mean)).select(key, "token", (f * F.lit(k1 + 1) / (f + F.lit(k1) * norm)).alias("impact"), "block")


def maxima(blocked: DataFrame) -> DataFrame:
    """Largest impact of each token in each block, and the documents that have it there."""
    return blocked.groupBy("token", "block").agg(F.max("impact").alias("top"), F.count("*").alias("df"))


@dataclass
class TopK:
    """Answer of ``top_k``, with the written steps that led to it."""

    best: DataFrame
    seeds: DataFrame
    candidates: DataFrame
    left: DataFrame

    def counts(self) -> dict[str, int]:
        """Pairs of query and document that each step scored."""
        return {"seeds": self.seeds.count(), "candidates": self.candidates.count(), "scored": self.left.count()}


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` (written ones, for they are counted), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _sums(pairs: DataFrame, blocked: DataFrame, weights: DataFrame, key: str, query_key: str) -> DataFrame:
    """Sum over the tokens in ``weights`` for each of ``pairs``; ``blocked`` holds these tokens alone."""
    met = blocked.select(key, "token", "impact").join(pairs, key).join(weights, [query_key, "token"])
    return met.groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("impact")).alias("sum"))


def _kth(scores: DataFrame, query_key: str, score: str, k: int) -> DataFrame:
    """The k-th best score of each query that has as many, less the margin."""
    order = W.partitionBy(query_key).orderBy(F.desc(score))
    ranked = scores.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return ranked.where(F.col("_n") == k).select(query_key, (F.col(score) - MARGIN).alias("threshold"))


def top_k(blocked: DataFrame, tops: DataFrame, weights: DataFrame, key: str, query_key: str, k: int) -> TopK:
    """The k best keys of each query: query_key, key, score; ties at six decimals go to the smaller key.

    ``weights`` (query_key, token, weight) has positive weights, ``blocked`` and ``tops`` come from ``impacts`` and ``maxima``.
    """
    weights = _sent(materialise(weights.select(query_key, "token", "weight"), "weights"))
    # Of postings and maxima, those of the queries' tokens are moved alone.
    words = _sent(materialise(weights.select("token").distinct(), "tokens"))
    blocked, tops = blocked.join(words, "token", "left_semi"), tops.join(words, "token", "left_semi")
    whole = tops.groupBy("token").agg(F.sum("df").alias("df")).join(weights, "token").select(query_key, "token", "df")
    rare = W.partitionBy(query_key).orderBy("df", "token").rowsBetween(W.unboundedPreceding, -1)
    first = whole.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < SEEDS * k).select(query_key, "token")
    first = _sent(materialise(first, "rare-tokens"))
    pairs = materialise(blocked.select(key, "token").join(first, "token").select(query_key, key).distinct(), "seeds")
    seeds = materialise(_sums(_sent(pairs), blocked, weights, key, query_key), "seed-scores")
    threshold = _sent(materialise(_kth(seeds, query_key, "sum", k), "threshold"))

    # A block's maxima lie in one task, where they meet the queries and are ordered: rows of query, token and block are neither moved nor written.
    split = tops.repartition("block").join(weights, "token").withColumn("most", F.col("weight") * F.col("top"))
    split = split.join(threshold, query_key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    cheap = W.partitionBy(query_key, "block").orderBy(F.col("most") / F.col("df"), "token").rowsBetween(W.unboundedPreceding, 0)
    split = split.withColumn("optional", F.sum("most").over(cheap) < F.col("threshold"))
    split = split.withColumn("rest", F.sum(F.when(F.col("optional"), F.col("most")).otherwise(0.0)).over(W.partitionBy(query_key, "block")))
    needed = split.where(~F.col("optional")).select(query_key, "token", "block", "weight", "rest")
    found = blocked.join(needed, ["token", "block"])
    candidates = found.groupBy(query_key, key, "block").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"), F.first("rest").alias("rest"))
    candidates = materialise(candidates, "candidates")

    risen = threshold.unionByName(_kth(candidates, query_key, "part", k)).groupBy(query_key).agg(F.max("threshold").alias("threshold"))
    candidates = candidates.join(_sent(materialise(risen, "risen")), query_key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    left = materialise(candidates.where(F.col("part") + F.col("rest") >= F.col("threshold")).select(query_key, key, "block", "part"), "left")
    scored = _sums(_sent(left.select(query_key, key)), blocked, weights, key, query_key).withColumnRenamed("sum", "score")
    rank = W.partitionBy(query_key).orderBy(F.desc(F.round("score", 6)), key)
    best = scored.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n")
    return TopK(best, seeds, candidates, left)
