"""A table in files by day, and late rows written into it.

A *layout* keeps one row of each key, the one that arrived last, in a folder for
each day of the row's event, sorted by event time and key, cut into files of a
stated number of rows. Late rows change it in place: only the days that lose or
gain a row are written again, by Spark's dynamic partition overwrite; all other
files stay as they are.

How rows get their place, with nothing gathered that grows with the rows:

* the row of a key is a window's ``row_number`` of one; Spark keeps one row of a
  key in each task before it shuffles (WindowGroupLimit), so a key that a third
  of the rows have is one row of each task;
* rows are dealt by *range* of (day, event, key), so a day is spread over as
  many tasks as it has rows for; sorted and written once, with the task and the
  number of the row within it, for ranges drawn again could differ;
* a row's rank within its day is its number in the task plus the rows of that
  day in the tasks before: a prefix sum over one count for each task and day;
* rank divided by the rows of a file is the file. Files are dealt to tasks by
  hash; a task's rows are sorted by day and place, and ``maxRecordsPerFile``
  cuts them: all files of a day but its last are full, so cuts fall where files end.

A task that is lost runs again from written or shuffled rows. An overwrite is
committed by moving finished files, after all tasks have ended.

Defined cases. Day: whole days of the event since 1970 in UTC, rounded down; -1
without an event. Null sorts first. A row without arrival is not early; among
late rows it comes before all that have one. Null is one key, as in PARTITION BY. Rows of a key
that arrived together: the later event stays, then the larger of the other columns in their order
(null is least); rows equal in all of them are the same. Other columns are kept;
the folders are named ``day``, or ``_day`` where there is such a column. An
empty table makes an empty folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType, TimestampNTZType

from lodestone.llm import _chunks as C
from lodestone.session import materialise, scratch_path

DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Keyed:
    """Columns of a table of versions: the row's key, the time that it tells of, the time at which it came."""

    key: str
    event: str
    arrival: str


SALES = Keyed("sale_id", "sold_at", "arrived_at")


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column is called so."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is one of UTC, whatever the session's zone."""
    if isinstance(rows.schema[column].dataType, TimestampNTZType):
        since = F.col(column) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return F.call_function("div", since, F.expr("INTERVAL '0.000001' SECOND"))
    return F.unix_micros(F.col(column))


def day(rows: DataFrame, column: str) -> Column:
    """Whole days since 1970; -1 without a time."""
    m, whole = micros(rows, column), F.lit(DAY_MICROS)
    return F.coalesce(F.call_function("div", m - F.pmod(m, whole), whole), F.lit(-1)).cast("long")


def latest(rows: DataFrame, t: Keyed) -> DataFrame:
    """The row of each key that arrived last."""
    (n,) = free_names(rows.columns, "n")
    rest = [f.name for f in rows.schema.fields if f.name not in (t.key, t.event, t.arrival) and not isinstance(f.dataType, MapType)]
    order = [F.col(c).desc_nulls_last() for c in (t.arrival, t.event, *rest)]
    return rows.withColumn(n, F.row_number().over(W.partitionBy(t.key).orderBy(*order))).where(F.col(n) == 1).drop(n)


def _remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class DayLayout:
    """Files of a keyed table by day below ``uri``, each but a day's last with ``per_file`` rows."""

    def __init__(self, spark: SparkSession, uri: str, schema: StructType, per_file: int, t: Keyed = SALES):
        self.spark, self.uri, self.schema, self.per_file, self.t = spark, uri, schema, per_file, t
        (self.folder,) = free_names(schema.names, "day")

    def read(self) -> DataFrame:
        """Rows and their day, from the files that are there now."""
        schema = StructType([*self.schema.fields, StructField(self.folder, LongType())])
        return self.spark.read.schema(schema).parquet(self.uri)

    def write(self, rows: DataFrame) -> list[int]:
        """Write ``rows``, one of each key, over the days that they have; return those days."""
        t, parts = self.t, C.partitions(self.spark)
        day_, part, row, place, file, shift = self.folder, *free_names([*rows.columns, self.folder], "part", "row", "place", "file", "shift")
        order = (day_, t.event, t.key)
        dealt = rows.withColumn(day_, day(rows, t.event)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # A row's number within its task is in the low 33 bits of this id.
        numbered = dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        path = scratch_path(self.spark, "ranked")
        numbered.write.parquet(path)
        ranked = self.spark.read.schema(numbered.schema).parquet(path)
        # A task has a range, so this has at most a row for each task and one for each day more.
        tally = ranked.groupBy(part, day_).agg(F.count("*").alias(place), F.min(row).alias(row))
        before = F.coalesce(F.sum(place).over(W.partitionBy(day_).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        tally = tally.select(part, day_, (before - F.col(row)).alias(shift))
        placed = ranked.join(F.broadcast(tally), [part, day_]).withColumn(place, F.col(row) + F.col(shift))
        cut = placed.withColumn(file, F.call_function("div", F.col(place), F.lit(self.per_file)))
        out = cut.repartition(parts, day_, file).sortWithinPartitions(day_, place).select(*self.schema.names, day_)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.per_file).partitionBy(day_).parquet(self.uri)
        days = [r[0] for r in tally.select(day_).distinct().collect()]
        _remove(self.spark, path)
        return days

    def apply(self, late: DataFrame) -> list[int]:
        """Bring late rows in, which arrived after all that is there; return the days that were written again or emptied.

        The key's late row stands for all it had. Days are a calendar's: their number does not follow the rows.
        """
        t = self.t
        kept = latest(late, t)
        kept = materialise(kept.withColumn(self.folder, day(kept, t.event)), "late-kept")
        there, keys = self.read(), kept.select(F.col(t.key).alias("late"))
        same = there[t.key].eqNullSafe(keys["late"])
        left = there.join(keys, same, "left_semi").select(self.folder)
        dirty = sorted(r[0] for r in left.unionByName(kept.select(self.folder)).distinct().collect())
        if dirty:
            early = there.where(F.col(self.folder).isin(dirty)).join(keys, same, "left_anti")
            columns = self.schema.names
            written = self.write(early.select(columns).unionByName(kept.select(columns)))
            # An overwrite leaves alone what it writes no row to.
            for d in set(dirty) - set(written):
                _remove(self.spark, f"{self.uri}/{self.folder}={d}")
        return dirty

    def files(self, amount: str | None = None) -> DataFrame:
        """For each file: its day, place within the day, rows, digests and the sum of ``amount`` in cents.

        A file's rows come to one task in their order and stream through it.
        """
        t, there = self.t, self.read()
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        key, event = text(F.col(t.key)), micros(there, t.event)
        value = F.coalesce(F.floor(F.col(amount) * 100 + 0.5), F.lit(0)) if amount else F.lit(0)
        rows = there.select(
            F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///").alias("path"),
            F.col("_metadata.row_index").alias("row"),
            F.col(self.folder).alias("day"),
            event.alias("event"),
            F.col(t.key).alias("first"),
            key.alias("key"),
            value.cast("long").alias("cents"),
            F.crc32(F.concat(key, F.lit(":"), text(event), F.lit(":"), text(micros(there, t.arrival)))).alias("crc"),
        )
        by = (F.xxhash64("path"), F.hash("path"))
        dealt = rows.repartition(C.partitions(self.spark), "path").sortWithinPartitions(*by, "row").drop("row")
        kind = self.schema[t.key].dataType.simpleString()
        found = dealt.mapInArrow(_digests, f"path string, day long, event long, first {kind}, n_rows long, cents long, rows_crc long, ids_sha256 string")
        # At most a row for each file.
        number = F.row_number().over(W.partitionBy("day").orderBy("event", "first")) - 1
        return found.withColumn("file_no", number.cast("long")).withColumn("columns", F.lit(",".join(self.schema.names))).drop("event", "first")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and digests of the files of a task, one file at a time, with each file's first event and key."""
    head: pa.RecordBatch | None = None
    name, n, cents, crc, sha = "", 0, 0, 0, hashlib.sha256()

    def close() -> pa.RecordBatch:
        whole = {"n_rows": pa.array([n], pa.int64()), "cents": pa.array([cents], pa.int64()), "rows_crc": pa.array([crc], pa.int64()), "ids_sha256": pa.array([sha.hexdigest()])}
        return pa.RecordBatch.from_arrays([*(head.column(c) for c in ("path", "day", "event", "first")), *whole.values()], names=["path", "day", "event", "first", *whole])

    for batch in batches:
        path = batch.column("path").dictionary_encode()
        code = path.indices.to_numpy()
        edges = [0, *((code[1:] != code[:-1]).nonzero()[0] + 1).tolist(), len(code)] if len(code) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            if head is None or name != path.dictionary[int(code[a])].as_py():
                if head is not None:
                    yield close()
                head, n, cents, crc, sha = part.slice(0, 1), 0, 0, 0, hashlib.sha256()
                name = path.dictionary[int(code[a])].as_py()
            else:
                sha.update(b",")
            sha.update(",".join(part.column("key").to_pylist()).encode())
            n += b - a
            cents += int(part.column("cents").to_numpy().sum())
            crc += int(part.column("crc").to_numpy().sum())
    if head is not None:
        yield close()


def resold(sales: DataFrame) -> DataFrame:
    """``sales`` and later versions of some: those with crc32(sale_id) % 3 = 0 on days divisible by 10."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    again = F.coalesce((h % 3 == 0) & (day(sales, "sold_at") % 10 == 0), F.lit(False))

    def later(column: str, n: Column) -> Column:
        if isinstance(sales.schema[column].dataType, TimestampNTZType):
            return F.col(column) + F.make_dt_interval(n.cast("int"))
        return F.timestamp_micros(F.unix_micros(F.col(column)) + n * DAY_MICROS)  # days of 24 hours, whatever the session's zone

    moved = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    return sales.unionByName(sales.where(again).withColumns(moved))


def overwrite_late(sales: DataFrame, cutoff: str = "2024-03-01 00:00:00", files: int = 900) -> DataFrame:
    """Lay out what arrived before ``cutoff``, bring in the rest, and report the files; a new folder at each call."""
    spark = sales.sparkSession
    rows = resold(sales)
    early = F.coalesce(micros(rows, "arrived_at") < F.unix_micros(F.to_timestamp(F.lit(f"{cutoff}+00:00"))), F.lit(False))
    layout = DayLayout(spark, scratch_path(spark, "sales-by-day"), sales.schema, 1 + sales.count() // files)
    layout.write(latest(rows.where(early), SALES))
    dirty = layout.apply(rows.where(~early))
    rewritten = F.col("day").isin(dirty) if dirty else F.lit(False)
    return layout.files("total").withColumn("rewritten", rewritten).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten")
