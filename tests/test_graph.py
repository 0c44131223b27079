import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G

NODES = [
    ("p/base/Cat/A", "A", "MetadataObject", "base", "Cat", None, None, 1), ("p/base/Doc/A", "A", "MetadataObject", "base", "Doc", None, None, 2),
    ("p/base/Cat/AB", "AB", "MetadataObject", "base", "Cat", None, None, 3), ("p/base/Cat/A/Attr/x", "x", "Attribute", "base", "Cat", "String", None, 4),
    ("p/base/Cat/AB/Attr/X", "X", "Attribute", "base", "Cat", "Ref.A", None, 5),
]
EDGES = [("p/base/Cat/A", "HAS_ATTRIBUTE", "p/base/Cat/A/Attr/x"), ("p/base/Cat/AB", "HAS_ATTRIBUTE", "p/base/Cat/AB/Attr/X")]
CALLS = [("r1", "CALLS", "r2"), ("r2", "CALLS", "r3"), ("r3", "CALLS", "r1"), ("r2", "CALLS", "r4"), ("r1", "CALLS", "r1")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "qn string, name string, label string, config_name string, category_name string, type_text string, note string, num long")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, rel string, dst string")


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, "src string, rel string, dst string")


def test_match_modes_ignore_case(nodes):
    names = lambda mode, n: sorted(r[0] for r in nodes.where(G.match("name", n, mode)).select("name").collect())
    assert names("exact", "a") == ["A", "A"] and names("starts_with", "a") == ["A", "A", "AB"] and names("contains", "B") == ["AB"]
    with pytest.raises(ValueError):
        G.match("name", "a", "like")


def test_subtree_excludes_siblings_with_the_same_beginning(nodes):
    assert sorted(r[0] for r in nodes.where(G.subtree("qn", "p/base/Cat/A")).select("qn").collect()) == ["p/base/Cat/A", "p/base/Cat/A/Attr/x"]


def test_owners_are_distinct(nodes, edges):
    assert sorted(r["owner_name"] for r in G.owners(nodes, edges, "HAS_ATTRIBUTE", "x").collect()) == ["A", "AB"]


def test_resolver_forms_and_ambiguity(nodes):
    assert G.resolve_one(nodes, "Cat.A") == "p/base/Cat/A" and G.resolve_one(nodes, "doc/a") == "p/base/Doc/A"
    assert G.resolve_one(nodes, "p/base/Cat/AB") == "p/base/Cat/AB"
    with pytest.raises(LookupError, match="2 objects"):
        G.resolve_one(nodes, "A")
    with pytest.raises(LookupError, match="0 objects"):
        G.resolve_one(nodes, "nothing")


def test_trails_use_no_edge_twice(spark, calls):
    seeds = spark.createDataFrame([("r1",)], "qn string")
    paths = {tuple(r["path"]) for r in G.trails(calls, "CALLS", seeds, 4).collect()}
    assert ("r1", "r2", "r3", "r1") in paths and ("r1", "r1", "r2", "r3", "r1") in {p for p in paths if len(p) == 5}
    assert all(len(set(zip(p, p[1:]))) == len(p) - 1 for p in paths)
    back = {tuple(r["path"]) for r in G.trails(calls, "CALLS", spark.createDataFrame([("r4",)], "qn string"), 2, True).collect()}
    assert back == {("r4", "r2"), ("r4", "r2", "r1")}


def test_simple_paths_use_no_node_twice(spark, calls):
    seeds = spark.createDataFrame([("r1",)], "qn string")
    steps = calls.select("src", "rel", "dst")
    assert {tuple(r["path"]) for r in G.simple_paths(steps, seeds, 3).collect()} == {("r1", "r2"), ("r1", "r2", "r3"), ("r1", "r2", "r4")}


def test_closure_has_no_depth_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(f"n{k:02}", "HAS_CHILD", f"n{k + 1:02}") for k in range(20)], "src string, rel string, dst string")
    seed = spark.createDataFrame([("n00",)], "qn string")
    assert G.closure(chain, ["HAS_CHILD"], seed).agg({"depth": "max"}).first()[0] == 20
    ring = spark.createDataFrame([("a", "HAS_CHILD", "b"), ("b", "HAS_CHILD", "a")], "src string, rel string, dst string")
    with pytest.raises(RecursionError):
        G.closure(ring, ["HAS_CHILD"], spark.createDataFrame([("a",)], "qn string"), guard=5)


def test_closure_holds_its_roots(spark):
    tree = spark.createDataFrame([("a", "HAS_CHILD", "b"), ("b", "HAS_CHILD", "c"), ("x", "HAS_CHILD", "y")], "src string, rel string, dst string")
    got = {(r["root"], r["node"], r["depth"]) for r in G.closure(tree, ["HAS_CHILD"], spark.createDataFrame([("a",)], "qn string")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)}


def test_expand_carries_edge_columns(nodes, edges):
    rows = G.expand(nodes, edges.withColumn("flag", F.lit(True)), "HAS_ATTRIBUTE", extra=("flag",)).collect()
    assert len(rows) == 2 and all(r["edge_flag"] for r in rows)


def test_recursive_sql_has_no_limit_of_rows(spark):
    from lodestone.plans import registry

    setting = "spark.sql.cteRecursionRowLimit"
    query = registry.queries()["jn05_recursive_sql"]
    whole = query(spark, "/root/testdata/sf0.001").count()
    was = spark.conf.get(setting)
    spark.conf.set(setting, "10")
    try:
        assert query(spark, "/root/testdata/sf0.001").count() == whole > 10
    finally:
        spark.conf.set(setting, was)
