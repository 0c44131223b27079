"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards; every shard has a weight and a node's
weight is the sum of those below it. A document descends from the root: at each
level every child draws ``ln(u) / weight`` from a hash u in (0, 1) of the key
and the child's name, and the largest draw wins, so a child gets its share by
weight. A draw depends on no other child. Hence

* if the weight of a child grows, keys move only into it; if it shrinks, only
  out of it; among the children whose weight is unchanged none moves;
* below an unchanged subtree nothing moves.

So a change is confined to the subtrees whose weights change. ``grow`` adds a
shard in a region of its own: all other weights stay, so the new shard takes
rows only into itself and no row moves between old ones (law ``key``). From 24
shards on, ``tree(n + 1)`` is ``grow(tree(n))``.

``slot`` numbers the rows of a shard from 0 without a gap. Every row gets a
number of its own where it is scanned, which is written with it; rows are dealt
to small buckets inside the shard by a hash of that number, a bucket's base is a
prefix sum over bucket counts, and rows are numbered within a bucket. No task
holds a shard, nor the rows of an id that repeats.

Defined cases: a null text has size 8 and the CRC of no bytes; a null doc_id is
hashed as a value of its own. Rows of one doc_id share a shard and have slots of
their own. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialise

#: Rows in a slot bucket, about.
BUCKET_ROWS = 20_000
#: Fan-out of the base layout: 3 regions of 4 racks of 2 shards.
RACKS, SHARDS = 4, 2
BASE = 24


@dataclass(frozen=True)
class Tree:
    """Weights by region, rack and shard; shards are numbered in this order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def size(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, the last, in a region and rack of its own."""
        return Tree((*self.weights, ((weight,),)))


def tree(shards: int) -> Tree:
    """The equal-weight tree of so many shards: the base layout, then one region for each further shard."""
    if shards < 1:
        raise ValueError("a tree has one shard at least")
    base = min(shards, BASE)
    regions, left = [], base
    while left:
        racks = []
        while left and len(racks) < RACKS:
            racks.append((1.0,) * min(SHARDS, left))
            left -= min(SHARDS, left)
        regions.append(tuple(racks))
    out = Tree(tuple(regions))
    for _ in range(shards - base):
        out = out.grow()
    return out


def _children(weights: tuple[tuple[tuple[float, ...], ...], ...]) -> Column:
    """The tree as one literal: regions of (name, weight, racks of (name, weight, shards of (name, weight, number)))."""
    regions, number = [], 0
    for i, region in enumerate(weights):
        racks = []
        for j, rack in enumerate(region):
            shards = []
            for k, weight in enumerate(rack):
                if weight > 0:
                    shards.append(_node(f"shard {i} {j} {k}", weight, k, F.lit(number)))
                number += 1
            if shards:
                racks.append(_node(f"rack {i} {j}", sum(rack), j, F.array(*shards)))
        if racks:
            regions.append(_node(f"region {i}", sum(map(sum, region)), i, F.array(*racks)))
    if not regions:
        raise ValueError("no shard has a weight")
    return F.array(*regions)


def _node(name: str, weight: float, place: int, below: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(place).alias("place"), below.alias("below"))


def _winner(key: Column, children: Column) -> Column:
    """What is below the child with the largest draw ln(u) / weight; below the first one in a tie.

    u is from 52 bits of the hash, never 0 or 1.
    """

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 12)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.log(u) / child["weight"]).alias("draw"), (-child["place"]).alias("first"), child["below"].alias("below"))

    return F.array_max(F.transform(children, draw))["below"]


def assign(df: DataFrame, key: Column, layout: Tree, name: str) -> DataFrame:
    """Add the shard of each row as column ``name``; a projection, nothing is shuffled.

    Each level is an argument of the next one and named once in it, so the
    expression has three draws for any layout, and a filter that the optimizer
    inlines adds three.
    """
    shards = _winner(key, _winner(key, _children(layout.weights)))
    return df.withColumn(name, _winner(key, shards).cast("int"))


def shard(docs: DataFrame, shards: int = BASE, layout: Tree | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    layout = layout or tree(shards)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = assign(rows, F.col("doc_id"), layout, "shard")
    rows = assign(rows, F.col("doc_id"), layout.grow(), "grown_shard")
    # Written with the row: a task that is run again finds the same number.
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "shards")
    # The count is read from the files' footers.
    buckets = max(1, -(-rows.count() // (bucket_rows * layout.size)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit("slot")), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("shard", "bucket").orderBy("row")
    numbered = rows.withColumn("place", F.row_number().over(within))
    return numbered.join(bases, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
