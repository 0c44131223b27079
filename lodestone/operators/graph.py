"""Graph operators over ``nodes`` and ``edges`` DataFrames.

Everything is a declared plan: one hop is an equi-join, optional hops are outer
joins, existence is a semi- or anti-join. Variable-length expansions iterate a
frontier join, to the end or to a stated depth; the steps, which every level joins, are
written to shared storage once, and so is each level of a closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

ELEMENT = ("qn", "name", "label", "config_name", "category_name")


def match(column: Column | str, needle: str, mode: str = "exact") -> Column:
    """Case-insensitive name match: ``exact``, ``starts_with`` or ``contains``."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    n = needle.lower()
    if mode == "exact":
        return c == n
    if mode == "starts_with":
        return c.startswith(n)
    if mode == "contains":
        return c.contains(n)
    raise ValueError(f"unknown match mode {mode}")


def scoped(nodes: DataFrame, config: str | None = None) -> DataFrame:
    """Nodes of one configuration; all if none is named."""
    return nodes if config is None else nodes.where(F.col("config_name") == config)


def subtree(column: Column | str, prefix: str) -> Column:
    """The path itself or below it; a sibling that merely begins alike is outside."""
    c = F.col(column) if isinstance(column, str) else column
    return (c == prefix) | c.startswith(prefix.rstrip("/") + "/")


def renamed(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns or ELEMENT])


def expand(nodes: DataFrame, edges: DataFrame, rel: str | list[str], left: str = "owner", right: str = "item", extra: tuple[str, ...] = ()) -> DataFrame:
    """One hop: (left node, edge columns, right node)."""
    rels = [rel] if isinstance(rel, str) else rel
    hop = edges.where(F.col("rel").isin(rels)).select("src", "dst", *[F.col(c).alias(f"edge_{c}") for c in extra])
    a = renamed(nodes, left)
    b = renamed(nodes, right, *ELEMENT, "type_text", "note", "num")
    return hop.join(a, F.col("src") == F.col(f"{left}_qn")).join(b, F.col("dst") == F.col(f"{right}_qn")).drop("src", "dst")


def owners(nodes: DataFrame, edges: DataFrame, rel: str, needle: str, mode: str = "exact") -> DataFrame:
    """Distinct objects that have a child of that name by that relation."""
    child = nodes.where(match("name", needle, mode)).select(F.col("qn").alias("dst"))
    owner = renamed(nodes.where(F.col("label") == "MetadataObject"), "owner", "qn", "name", "config_name", "category_name")
    hop = edges.where(F.col("rel") == rel).select("src", "dst").join(child, "dst")
    return hop.join(owner, F.col("src") == F.col("owner_qn")).select("owner_qn", "owner_name", "owner_config_name", "owner_category_name").distinct()


def closure(edges: DataFrame, rels: list[str], seeds: DataFrame, guard: int = 1000) -> DataFrame:
    """(root, node, depth) for every node reachable from the seeds, seeds included, along a tree of any depth.

    ``seeds`` has the column qn. A tree has one path to a node, so no visited
    set is needed; the loop ends as soon as a level is empty. More than
    ``guard`` levels mean a cycle and are an error.
    """
    hop = materialise(edges.where(F.col("rel").isin(rels)).select(F.col("src").alias("node"), F.col("dst").alias("next")), "steps")
    level = materialise(seeds.select(F.col("qn").alias("root"), F.col("qn").alias("node"), F.lit(0).alias("depth")), "level")
    out = level
    for d in range(1, guard + 1):
        level = materialise(level.join(hop, "node").select("root", F.col("next").alias("node"), F.lit(d).alias("depth")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RecursionError(f"more than {guard} levels along {rels}: a cycle")


def trails(edges: DataFrame, rel: str, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Trails (no edge twice) of 1 to ``depth`` hops: root, path of nodes, hops."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    hop = materialise(edges.where(F.col("rel") == rel).select(F.col(src).alias("last"), F.col(dst).alias("next")), "steps")
    level = seeds.select(F.col("qn").alias("root"), F.array("qn").alias("path"), F.array().cast("array<string>").alias("used"), F.col("qn").alias("last"))
    out = None
    for d in range(1, depth + 1):
        edge = F.concat_ws("\u0001", "last", "next")
        level = level.join(hop, "last").where(~F.array_contains("used", edge))
        level = materialise(level.select("root", F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array(edge)).alias("used"), F.col("next").alias("last")), "level")
        found = level.select("root", "path", F.lit(d).alias("hops"))
        out = found if out is None else out.unionByName(found)
    return out


def simple_paths(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Simple paths (no node twice) along ``steps`` (src, rel, dst) of 1 to ``depth`` hops; see ``paths`` for those with owners."""
    hop = materialise(steps.select(F.col("src").alias("last"), F.col("rel").alias("via"), F.col("dst").alias("next")), "steps")
    level = seeds.select(F.col("qn").alias("root"), F.array("qn").alias("path"), F.array().cast("array<string>").alias("rels"), F.col("qn").alias("last"))
    out = None
    for d in range(1, depth + 1):
        level = level.join(hop, "last").where(~F.array_contains("path", F.col("next")))
        level = materialise(level.select("root", F.concat("path", F.array("next")).alias("path"), F.concat("rels", F.array("via")).alias("rels"), F.col("next").alias("last")), "level")
        found = level.select("root", "path", "rels", F.lit(d).alias("depth"))
        out = found if out is None else out.unionByName(found)
    return out


def resolve(nodes: DataFrame, ref: str, label: str = "MetadataObject") -> DataFrame:
    """Candidates of a reference: full path, ``Category/Name``, ``Category.Name`` or name; the first form that hits wins."""
    pool = nodes.where(F.col("label") == label)
    parts = ref.replace("/", ".").split(".")
    rank = F.when(F.col("qn") == ref, 0)
    if len(parts) == 2:
        rank = rank.when(match("category_name", parts[0]) & match("name", parts[1]), 1)
    rank = rank.when(match("name", ref), 2)
    found = pool.withColumn("how", rank).where("how is not null")
    best = found.agg(F.min("how").alias("how"))
    return found.join(F.broadcast(best), "how").select("qn", "name", "config_name", "category_name")


def resolve_one(nodes: DataFrame, ref: str, label: str = "MetadataObject") -> str:
    """The one path that a reference names; an error lists the candidates otherwise."""
    found = [r["qn"] for r in resolve(nodes, ref, label).orderBy("qn").limit(11).collect()]
    if len(found) != 1:
        raise LookupError(f"{ref!r} names {len(found) if len(found) < 11 else 'more than 10'} objects: {found[:10]}")
    return found[0]
