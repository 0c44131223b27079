"""Postings and their statistics, kept by signed deltas.

A change of some documents appends what they had, with sign -1, and what they have now, with
sign +1, as one *epoch* in files of its own. Document frequency, number of documents and total length are sums over signs,
so the statistics of an epoch are a few rows for each token that it touches, and are merged on
read: neither postings nor statistics of documents that did not change are read or
written again. ``compact`` folds all epochs into one.

An epoch is written by overwriting the partition of its number, so a repeated run leaves it
once, and reads only those before it. Epochs are applied one after the other.

Defined cases: a changed document without tokens has length 0 and counts as no document, as in a
rebuild; a change of an unknown document is an addition, a deletion of one does nothing; of several changes
of a document in one epoch there must be one. Null keys are no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T


class PostingStore:
    """Signed postings (key, token, tf, sign) and statistics (token, df, tf; a null token counts documents) by epoch."""

    def __init__(self, spark: SparkSession, uri: str, key: str = "doc_id", kind: str = "long"):
        self.spark, self.uri, self.key, self.kind = spark, uri, key, kind

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, epoch int").parquet(f"{self.uri}/{name}")

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        out = rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("epoch").parquet(f"{self.uri}/{name}")

    def _signed(self) -> DataFrame:
        return self._read("postings", f"{self.key} {self.kind}, token string, tf long, sign int")

    def rebuild(self, docs: DataFrame, words: Column) -> None:
        """Epoch 0, from all documents."""
        self._append(T.postings(docs.where(F.col(self.key).isNotNull()), self.key, words).withColumn("sign", F.lit(1)), 0)

    def _append(self, signed: DataFrame, epoch: int) -> None:
        self._write(signed.select(self.key, "token", "tf", "sign"), "postings", epoch)
        new = self._signed().where(F.col("epoch") == epoch)
        tokens = new.groupBy("token").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("tf"))
        docs = new.select(self.key, "sign").distinct().agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("df"), F.lit(0).cast("long").alias("tf"))
        self._write(tokens.unionByName(docs.select(F.lit(None).cast("string").alias("token"), "df", "tf")), "statistics", epoch)

    def apply(self, epoch: int, changed: DataFrame, words: Column, deleted: DataFrame | None = None) -> None:
        """Add or replace the documents ``changed`` and drop the keys of ``deleted``."""
        known = self.postings(before=epoch)
        keys = changed.select(self.key)
        keys = keys if deleted is None else keys.unionByName(deleted.select(self.key))
        had = known.join(keys.distinct(), self.key, "left_semi").withColumn("sign", F.lit(-1))
        have = T.postings(changed.where(F.col(self.key).isNotNull()), self.key, words).withColumn("sign", F.lit(1))
        self._append(had.unionByName(have), epoch)

    def postings(self, before: int | None = None) -> DataFrame:
        """key, token, tf of the documents as they are, or as they were before an epoch."""
        rows = self._signed() if before is None else self._signed().where(F.col("epoch") < before)
        return rows.groupBy(self.key, "token").agg(F.sum(F.col("sign") * F.col("tf")).alias("tf")).where("tf <> 0")

    def _statistics(self) -> DataFrame:
        return self._read("statistics", "token string, df long, tf long").groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    def frequencies(self) -> DataFrame:
        """token, df and tf of the tokens that a document has."""
        return self._statistics().where("token is not null and df <> 0")

    def totals(self) -> DataFrame:
        """One row: docs and total length."""
        return self._statistics().agg(F.coalesce(F.sum(F.when(F.col("token").isNull(), F.col("df"))), F.lit(0)).alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))

    def compact(self, uri: str) -> PostingStore:
        """All epochs as epoch 0 of a new store; this one stays as it is."""
        new = PostingStore(self.spark, uri, self.key, self.kind)
        new._append(self.postings().withColumn("sign", F.lit(1)), 0)
        return new
