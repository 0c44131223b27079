"""Relational building blocks: upserts, paging, ranks, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp_limit(value: object, default: int = 50, most: int = 500) -> int:
    """A limit in [1, most]; the default where it does not parse."""
    try:
        return max(1, min(most, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def clamp_offset(value: object) -> int:
    """An offset of 0 or more; 0 where it does not parse."""
    try:
        return max(0, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return 0


def clamped(column: str, least: int, most: int | None, default: int) -> Column:
    """A text column as a number within bounds; the default where it does not parse."""
    number = F.greatest(F.lit(least), F.coalesce(F.expr(f"try_cast({column} as int)"), F.lit(default)))
    return number if most is None else F.least(F.lit(most), number)


def has_more(legs: list[DataFrame], key: str, item: str, budget: int, page_end: int) -> DataFrame:
    """key, pool (distinct items of all legs) and whether more follow the page that ends at ``page_end``.

    If no leg used its whole budget, the pool is all there is and the answer is
    exact; if one did, more may exist, and a full page says so: a false yes costs
    an empty page, a false no would lose results.
    """
    counted = None
    for leg in legs:
        full = leg.groupBy(key).agg((F.count("*") >= budget).alias("full"))
        mine = leg.select(key, item).join(full, key)
        counted = mine if counted is None else counted.unionByName(mine)
    pool = counted.groupBy(key).agg(F.countDistinct(item).alias("pool"), F.max("full").alias("full"))
    return pool.select(key, "pool", F.when(F.col("full"), F.col("pool") >= page_end).otherwise(F.col("pool") > page_end).alias("has_more"))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, bool, int | None]:
    """One page, whether more follow, and the next offset, by looking one row ahead."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = rows.count() > limit
    return df.orderBy(*order).offset(offset).limit(limit), more, offset + limit if more else None


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "place") -> DataFrame:
    """First n rows of each key."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert: the row of the highest sequence number wins, whole. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(seq)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def first_written(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Set on creation only: the row of the lowest sequence number stays."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(seq)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def without(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been returned yet."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, lo, hi."""
    d = df.select(*keys, number).distinct()
    run = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    return d.withColumn("run", run).groupBy(*keys, "run").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).drop("run")


def min_max(column: str, keys: list[str], flat: float) -> Column:
    """Value scaled to [0, 1] within its group; ``flat`` where all are equal."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(F.lit(flat))


def interleave(df: DataFrame, group: str, rank: str, quotas: list[int], total: int, order: list) -> DataFrame:
    """Take ``quotas[k]`` rows of the k-th group, then fill by global order up to ``total``.

    ``group`` numbers the groups from 1, ``rank`` the rows within a group from 1.
    """
    quota = F.lit(0)
    for k, q in enumerate(quotas, 1):
        quota = F.when(F.col(group) == k, F.lit(q)).otherwise(quota)
    staged = df.withColumn("first", F.when(F.col(rank) <= quota, 0).otherwise(1))
    # Only the quotas' rows and the best of the rest can get a slot, so few rows are numbered together.
    rest = staged.where("first = 1").orderBy(*order).limit(total)
    few = staged.where("first = 0").unionByName(rest)
    return few.withColumn("slot", F.row_number().over(W.orderBy("first", *order))).where(F.col("slot") <= total)


def best_window(df: DataFrame, parent: str, position: str, score: str, size: int) -> DataFrame:
    """The contiguous window of up to ``size`` rows with the largest score sum in each parent; the first in a tie."""
    ahead = W.partitionBy(parent).orderBy(position).rowsBetween(W.currentRow, size - 1)
    summed = df.withColumn("window_score", F.sum(score).over(ahead))
    return top_n(summed, [parent], [F.desc("window_score"), F.asc(position)], 1).select(parent, F.col(position).alias("window_start"), "window_score")
