"""Incremental maintenance: watermarks, diffs, leases, epochs, and streaming counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import scratch_path

ROUTINE_STATES = ("added", "deleted", "signature_changed", "body_changed", "doc_changed", "line_only", "unchanged")


def candidates(listing: DataFrame, watermark: Column, overlap_seconds: int = 60) -> DataFrame:
    """Rows modified since the watermark less an overlap."""
    return listing.where(F.col("modified") >= watermark - F.expr(f"INTERVAL {overlap_seconds} SECONDS"))


def stat_prefilter(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """path and state; the content hash decides only where size or time differ."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("modified").alias("m_modified"), F.col("hash").alias("m_hash"))
    n = listing.select("path", F.col("size").alias("n_size"), F.col("modified").alias("n_modified"), F.col("hash").alias("n_hash"))
    same_stat = (F.col("m_size") == F.col("n_size")) & (F.col("m_modified") == F.col("n_modified"))
    state = (
        F.when(F.col("m_hash").isNull(), "added").when(F.col("n_hash").isNull(), "deleted")
        .when(same_stat | (F.col("m_hash") == F.col("n_hash")), "unchanged").otherwise("changed")
    )
    return m.join(n, "path", "full").select("path", state.alias("state"))


def routine_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """One of seven states for each routine; a moved file counts as a changed body.

    Both sides have id, signature, body, doc, line and file.
    """
    fields = ("signature", "body", "doc", "line", "file")
    o = old.select("id", *[F.col(c).alias(f"o_{c}") for c in fields], F.lit(True).alias("in_old"))
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("in_new"))
    differs = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    state = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(differs("signature"), "signature_changed")
        .when(differs("body") | differs("file"), "body_changed").when(differs("doc"), "doc_changed").when(differs("line"), "line_only").otherwise("unchanged")
    )
    return o.join(n, "id", "full").select("id", state.alias("state"))


def stale_leases(beats: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Leases whose last heartbeat is older than the time to live, with their last owner."""
    last = beats.groupBy("name").agg(F.max("beat").alias("last_beat"), F.max_by("owner", F.struct("beat", "owner")).alias("owner"))
    return last.where(F.col("last_beat") < now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


class EpochStore:
    """Versions of a table as folders and a pointer: build aside, flip, retire, collect.

    The pointer is the highest row of an append-only table, written after the
    epoch's files: readers see the old epoch or the whole new one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("epoch int, retired boolean").parquet(f"{self.root}/pointer")
        except Exception as error:  # no epoch has been published yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def current(self) -> int:
        pointers = self._pointers()
        found = pointers.agg(F.max("epoch")).first()[0] if pointers is not None else None
        return found or 0

    def publish(self, df: DataFrame) -> int:
        epoch = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")
        self.spark.createDataFrame([(epoch, False)], "epoch int, retired boolean").coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return epoch

    def read(self, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/epoch={self.current()}")

    def collectable(self, keep: int = 1) -> list[int]:
        """Epochs older than the current one by more than ``keep``."""
        return list(range(1, self.current() - keep))


def read_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; at most ``files_a_batch`` files are taken at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*.parquet")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder if single else path)


class CircuitOpen(RuntimeError):
    """A consumer failed too often in a row."""


def guarded(put, most: int = 3):
    """``put`` of a batch, tried again when it fails; after ``most`` failures in a row the circuit opens and the stream stops.

    A batch is written under its epoch, so a second try replaces what the first one left.
    """

    def consume(batch: DataFrame, epoch: int) -> None:
        for k in range(1, most + 1):
            try:
                return put(batch, epoch)
            except Exception as error:
                if k == most:
                    raise CircuitOpen(f"{most} failures in a row at epoch {epoch}") from error

    return consume


def drain(spark: SparkSession, stream: DataFrame, mode: str, out: str, log: str, put=None) -> list[int]:
    """One cycle: run a stream to the end of what is there; rows taken in by each batch.

    In complete mode a batch replaces the table ``out``; else each batch is a
    folder of it, named by its epoch. Cycles that share ``log`` go on where the
    last one ended, so a scheduler need only call this again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(guarded(put or write)).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def stream_table(spark: SparkSession, path: str, schema: StructType, build, mode: str = "complete", files_a_batch: int | None = None) -> DataFrame:
    """Run ``build`` over a folder of Parquet files as a stream, to the end of what is there, and return its table.

    The sink is on shared storage; the checkpoint lies there too.
    """
    out = scratch_path(spark, "stream")
    stream = build(read_stream(spark, path, schema, files_a_batch))
    drain(spark, stream, mode, out, scratch_path(spark, "stream-log"))
    # The epoch is a folder of the store, no column of the table.
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def cycles(spark: SparkSession, path: str, schema: StructType, times: int) -> list[tuple[int, int]]:
    """(cycle, rows taken in) of a stream that is started so many times; a later cycle takes only what is new."""
    out, log = scratch_path(spark, "stream"), scratch_path(spark, "stream-log")
    return [(k, sum(drain(spark, read_stream(spark, path, schema), "append", out, log))) for k in range(1, times + 1)]
