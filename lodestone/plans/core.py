"""Predicates, joins, aggregations, windows and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import relational as R
from lodestone.plans.registry import register
from lodestone.session import scratch_path
from lodestone.sources.projection import Graph, duck, table
from lodestone.streaming.postings import PostingStore


class Data:
    """Tables of a data directory by attribute."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def add(name: str, sql: str | None, build) -> None:
    register(name, sql)(lambda spark, sf_dir: build(Data(spark, sf_dir)))


def add_graph(name: str, sql: str, build) -> None:
    register(name, duck(sql))(lambda spark, sf_dir: build(Graph(spark, sf_dir)))


# --- projections, filters, predicates ---------------------------------------------------------------------

for _mode, _sql in (("exact", "lower(p_brand) = 'brand#13'"), ("starts_with", "starts_with(lower(p_name), 'red')"), ("contains", "contains(lower(p_type), 'a')")):
    _col, _needle = {"exact": ("p_brand", "BRAND#13"), "starts_with": ("p_name", "RED"), "contains": ("p_type", "A")}[_mode]
    add(f"pr01_{_mode}", f"SELECT p_partkey, p_name FROM part WHERE {_sql}", lambda d, m=_mode, c=_col, n=_needle: d.part.where(G.match(c, n, m)).select("p_partkey", "p_name"))
add_graph("pr02_scope", "SELECT qn, label FROM nodes WHERE config_name = 'ASIA'", lambda g: G.scoped(g.nodes, "ASIA").select("qn", "label"))
add_graph("pr03_subtree", "SELECT qn FROM nodes WHERE qn = 'tpch/ASIA' OR starts_with(qn, 'tpch/ASIA/')", lambda g: g.nodes.where(G.subtree("qn", "tpch/ASIA")).select("qn"))


def _members(df: DataFrame, column: str, wanted: list[str], known: list[str]) -> DataFrame:
    """Rows of the wanted categories; none wanted means all, only unknown ones mean none."""
    if not wanted:
        return df
    hits = [w for w in wanted if w in known]
    return df.where(F.col(column).isin(hits)) if hits else df.where(F.lit(False))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
add("pr04_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", lambda d: _members(d.customer, "c_mktsegment", ["BUILDING", "MACHINERY", "NOWHERE"], _SEGMENTS).select("c_custkey", "c_mktsegment"))
add("pr04_unknown_category", "SELECT c_custkey FROM customer WHERE false", lambda d: _members(d.customer, "c_mktsegment", ["NOWHERE"], _SEGMENTS).select("c_custkey"))
add("pr05_any_element", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: ends_with(x, 't'))) > 0", lambda d: d.part.where(F.exists(F.split("p_name", " "), lambda x: x.endswith("t"))).select("p_partkey"))
add("pr06_alias_keys", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS state FROM orders", lambda d: d.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("state")))
add(
    "pr07_property_filter",
    "SELECT doc_id, concat_ws(';', 'lang=' || lang, 'source=' || source) AS kept FROM documents",
    lambda d: d.documents.select(
        "doc_id",
        F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"), F.lit("source"), F.col("source")), lambda k, v: ~k.isin("text", "embedding") & v.isNotNull())), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("kept"),
    ),
)
add("pr09_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", lambda d: d.customer.join(d.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"))
add("pr09_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", lambda d: d.customer.join(d.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"))
add_graph(
    "pr10_resolve",
    "SELECT qn, name, config_name, category_name FROM nodes WHERE label = 'MetadataObject' AND lower(name) = 'customer#000000010'",
    lambda g: G.resolve(g.of("MetadataObject"), "Customer#000000010"),
)
add_graph(
    "pr11_section_path",
    "SELECT c.qn FROM nodes o JOIN edges a ON a.src = o.qn AND a.rel = 'HAS_TABULAR_PART' JOIN edges b ON b.src = a.dst AND b.rel = 'HAS_ATTRIBUTE' JOIN nodes c ON b.dst = c.qn WHERE o.category_name = 'NATION_1' AND ends_with(c.qn, '/1')",
    lambda g: g.sources("HAS_TABULAR_PART").where("category_name = 'NATION_1'").select(F.col("qn").alias("src")).join(g.links("HAS_TABULAR_PART").select("src", "dst"), "src")
    .select(F.col("dst").alias("src")).join(g.links("HAS_ATTRIBUTE").select("src", "dst"), "src").where(F.element_at(F.split("dst", "/"), -1) == "1").select(F.col("dst").alias("qn")),
)
add(
    "pr12_adaptive_threshold",
    "SELECT item_id, len(string_split(text, ' ')) AS n, CASE WHEN len(string_split(text, ' ')) <= 2 THEN 0.25 WHEN len(string_split(text, ' ')) <= 30 THEN 0.2 ELSE 0.15 END::DOUBLE AS threshold FROM benchmark",
    lambda d: d.benchmark.withColumn("n", F.size(F.split("text", " ")).cast("long")).select("item_id", "n", F.when(F.col("n") <= 2, 0.25).when(F.col("n") <= 30, 0.2).otherwise(0.15).alias("threshold")),
)
add(
    "pr13_coverage_policy",
    "SELECT doc_id, NOT (lang IN ('fr', 'es') OR (lang = 'de' AND starts_with(source, 'src1'))) AS covered FROM documents",
    lambda d: d.documents.select("doc_id", (~(F.col("lang").isin("fr", "es") | ((F.col("lang") == "de") & F.col("source").startswith("src1")))).alias("covered")),
)

# --- joins --------------------------------------------------------------------------------------------------

add("jn01_expand", "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 2", lambda d: d.nation.where("n_regionkey = 2").join(d.customer, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey"))
add(
    "jn02_chain",
    "SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'",
    lambda d: d.region.join(d.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(d.customer, F.col("n_nationkey") == F.col("c_nationkey")).join(d.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")).select("r_name", "n_name", "c_custkey", "o_orderkey"),
)
add(
    "jn03_optional_collect",
    "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') AS statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    lambda d: d.customer.join(d.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses")),
)
add("jn04_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')", lambda d: d.supplier.join(d.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey"))
add("jn04_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", lambda d: d.part.join(d.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey"))


def _duck_recursive(body: str, select: str) -> str:
    text = duck("SELECT 0")
    return text[: text.rindex(" SELECT 0")].replace("WITH ", "WITH RECURSIVE ", 1) + f", {body} {select}"


register(
    "jn05_child_closure",
    _duck_recursive(
        "tree AS (SELECT qn AS root, qn AS node, 0 AS depth FROM nodes WHERE label = 'FormControl' UNION ALL SELECT t.root, e.dst, t.depth + 1 FROM tree t JOIN edges e ON e.src = t.node AND e.rel = 'HAS_CHILD')",
        "SELECT root, node, depth FROM tree",
    ),
)(lambda spark, sf_dir: (lambda g: G.closure(g.links("HAS_CHILD"), ["HAS_CHILD"], g.of("FormControl")))(Graph(spark, sf_dir)))


def _native_closure(spark, sf_dir) -> DataFrame:
    """The same closure as a recursive common table expression of Spark SQL, which stops at the first empty level.

    ``LIMIT ALL`` lifts the limit of a million rows that Spark sets a recursion.
    """
    g = Graph(spark, sf_dir)
    return spark.sql(
        """WITH RECURSIVE tree(root, node, depth) AS (SELECT qn, qn, 0 FROM {seeds}
           UNION ALL SELECT t.root, s.dst, t.depth + 1 FROM tree t JOIN {steps} s ON s.src = t.node)
           SELECT root, node, depth FROM tree LIMIT ALL""",
        seeds=g.of("FormControl").select("qn"), steps=g.links("HAS_CHILD").select("src", "dst"),
    )


register(
    "jn05_recursive_sql",
    _duck_recursive(
        "tree AS (SELECT qn AS root, qn AS node, 0 AS depth FROM nodes WHERE label = 'FormControl' UNION ALL SELECT t.root, e.dst, t.depth + 1 FROM tree t JOIN edges e ON e.src = t.node AND e.rel = 'HAS_CHILD')",
        "SELECT root, node, depth FROM tree",
    ),
)(_native_closure)
add(
    "jn06_bounded_calls",
    """WITH RECURSIVE c AS (SELECT DISTINCT event_type AS a, nxt AS b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) x WHERE nxt IS NOT NULL),
    w AS (SELECT a AS root, b AS node, 1 AS hops, [a || '>' || b] AS used FROM c WHERE a = 'click' UNION ALL SELECT w.root, c.b, w.hops + 1, list_append(w.used, c.a || '>' || c.b) FROM w JOIN c ON c.a = w.node WHERE w.hops < 3 AND NOT list_contains(w.used, c.a || '>' || c.b))
    SELECT root, node, min(hops) AS depth, count(*) AS trails FROM w GROUP BY root, node""",
    lambda d: G.trails(
        d.events.withColumn("dst", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("dst is not null").select(F.col("event_type").alias("src"), F.lit("CALLS").alias("rel"), "dst").distinct(),
        "CALLS", d.spark.createDataFrame([("click",)], "qn string"), 3,
    ).groupBy("root", F.element_at("path", -1).alias("node")).agg(F.min("hops").alias("depth"), F.count("*").alias("trails")),
)
add_graph(
    "jn07_path_rewrite",
    "SELECT e.qn AS ext_qn, b.qn AS base_qn FROM rebased e JOIN nodes b ON b.qn = e.base_qn",
    lambda g: g.nodes.where("is_extension and label <> 'Configuration'").select(F.col("qn").alias("ext_qn"), F.array_join(F.transform(F.split("qn", "/"), lambda x, i: F.when(i == 1, F.regexp_replace(x, "^EXT_", "")).otherwise(x)), "/").alias("base_qn")).join(g.nodes.select(F.col("qn").alias("base_qn")), "base_qn").select("ext_qn", "base_qn"),
)
add_graph(
    "jn08_fallback_chain",
    "SELECT n.qn, coalesce(a.dst, b.qn, n.qn) AS target FROM nodes n LEFT JOIN edges a ON a.src = n.qn AND a.rel = 'ADOPTED_FROM' LEFT JOIN nodes b ON b.qn = replace(n.qn, '_X', '_') AND b.qn <> n.qn WHERE n.is_extension AND n.label = 'Resource'",
    lambda g: g.of("Resource").where("is_extension").select("qn", F.replace("qn", F.lit("_X"), F.lit("_")).alias("own")).join(g.links("ADOPTED_FROM").where("dst_label = 'Resource'").select(F.col("src").alias("qn"), F.col("dst").alias("adopted")), "qn", "left")
    .join(g.of("Resource").select(F.col("qn").alias("own"), F.col("qn").alias("found")), "own", "left").select("qn", F.coalesce("adopted", F.when(F.col("found") != F.col("qn"), F.col("found")), "qn").alias("target")),
)
add_graph(
    "jn09_type_literals",
    "SELECT n.qn AS element_qn, s.qn AS target_qn FROM (SELECT qn, unnest(string_split(type_text, ',')) AS lit FROM nodes WHERE label = 'FormAttribute') n JOIN nodes s ON s.category_name = 'Suppliers' AND 'SupplierRef.S' || CAST(s.num AS VARCHAR) = n.lit",
    lambda g: g.of("FormAttribute").select(F.col("qn").alias("element_qn"), F.explode(F.split("type_text", ",")).alias("lit")).join(g.of("MetadataObject").where("category_name = 'Suppliers'").select(F.col("qn").alias("target_qn"), F.concat(F.lit("SupplierRef.S"), F.col("num").cast("string")).alias("lit")), "lit").select("element_qn", "target_qn"),
)
add_graph(
    "jn10_data_path",
    """SELECT control, target, how FROM (SELECT c.qn AS control, t.qn AS target, t.how, row_number() OVER (PARTITION BY c.qn ORDER BY t.how, t.qn) AS k FROM nodes c JOIN (SELECT owner_qn, qn, CASE label WHEN 'FormAttribute' THEN 1 WHEN 'Command' THEN 2 ELSE 3 END AS how FROM nodes WHERE label IN ('FormAttribute', 'Command', 'FormEvent')) t ON t.owner_qn = c.owner_qn WHERE c.label = 'FormControl') x WHERE k = 1""",
    lambda g: R.top_n(
        g.of("FormControl").select(F.col("qn").alias("control"), "owner_qn").join(
            g.of("FormAttribute", "Command", "FormEvent").select("owner_qn", F.col("qn").alias("target"), F.when(F.col("label") == "FormAttribute", 1).when(F.col("label") == "Command", 2).otherwise(3).alias("how")), "owner_qn"),
        ["control"], ["how", "target"], 1).select("control", "target", "how"),
)


def _callsites(d: Data) -> DataFrame:
    """Call sites (line items) to routines (parts): same name, arguments within the arity range, directives compatible; the narrowest wins.

    Of the routines that fit a name, a number of arguments and a side, only the
    narrowest can win: routines are reduced to one for each of these first, by an
    aggregate that combines before its shuffle. A site then has one partner for
    each side, found by equality, and none is compared with all of its name.
    """
    routines = d.part.select((F.col("p_partkey") % 40).alias("name"), F.explode(F.sequence(F.col("p_size") % 10, F.col("p_size") % 10 + 15)).alias("args"), F.substring("p_type", 1, 1).eqNullSafe("S").alias("server"), F.struct((F.col("p_size") % 10).alias("least"), (F.col("p_size") % 10 + 15).alias("most"), "p_partkey").alias("routine"))
    best = routines.groupBy("name", "args").agg(F.min("routine").alias("any"), F.min(F.when(~F.col("server"), F.col("routine"))).alias("client"))
    sites = d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("args"), F.col("l_returnflag").alias("directive")).distinct()
    found = sites.withColumn("name", F.col("l_partkey") % 40).join(best, ["name", "args"])
    callee = F.when(F.col("directive") == "R", F.col("client.p_partkey")).otherwise(F.col("any.p_partkey"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "args", "directive", callee.alias("callee")).where("callee is not null")


add(
    "jn11_call_sites",
    """SELECT l_orderkey, l_linenumber, l_partkey, args, directive, p_partkey AS callee FROM (SELECT s.*, p.p_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, args, directive ORDER BY p_size % 10, p_size % 10 + 15, p_partkey) AS k
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS args, l_returnflag AS directive FROM lineitem) s JOIN part p ON s.l_partkey % 40 = p.p_partkey % 40 AND s.args BETWEEN p.p_size % 10 AND p.p_size % 10 + 15 AND (s.directive <> 'R' OR substring(p.p_type, 1, 1) <> 'S')) x WHERE k = 1""",
    _callsites,
)
add_graph(
    "jn12_handlers",
    "SELECT m.qn AS method_qn, r.qn AS routine_qn FROM nodes m JOIN edges h ON h.src = m.qn AND h.rel = 'HAS_HANDLER' JOIN nodes r ON lower(r.qn) = lower(h.dst)",
    lambda g: g.sources("HAS_HANDLER").select(F.col("qn").alias("src")).join(g.links("HAS_HANDLER").select("src", F.lower("dst").alias("key")), "src").join(g.targets("HAS_HANDLER").select(F.col("qn").alias("routine_qn"), F.lower("qn").alias("key")), "key").select(F.col("src").alias("method_qn"), "routine_qn"),
)
add_graph(
    "jn13_rights_targets",
    "SELECT e.src AS role_qn, n.label AS target_label, n.name AS target_name FROM edges e JOIN nodes n ON replace(replace(e.dst, '/', '.'), '.', '/') = n.qn WHERE e.rel = 'GRANTS_ACCESS_TO'",
    lambda g: g.links("GRANTS_ACCESS_TO").select(F.col("src").alias("role_qn"), F.array_join(F.split("dst", "/"), ".").alias("dotted")).withColumn("qn", F.array_join(F.split("dotted", r"\."), "/")).join(g.targets("GRANTS_ACCESS_TO").select("qn", F.col("label").alias("target_label"), F.col("name").alias("target_name")), "qn").select("role_qn", "target_label", "target_name"),
)
add(
    "jn14_text_calls",
    """SELECT w.doc_id, w.word, n AS uses FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)\\.', 1)) AS word FROM documents) x GROUP BY doc_id, word) w JOIN (SELECT word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)\\.', 1)) AS word FROM documents) y GROUP BY word HAVING count(DISTINCT doc_id) = 1) u ON w.word = u.word""",
    lambda d: (lambda w: w.groupBy("doc_id", "word").agg(F.count("*").alias("uses")).join(w.groupBy("word").agg(F.countDistinct("doc_id").alias("docs")).where("docs = 1").select("word"), "word").select("doc_id", "word", "uses"))(
        d.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)\."), F.lit(1))).alias("word"))
    ),
)
#: Targets of a class that one task pairs with the sites that reach it.
CLASS_SLICE = 20_000


def _overlaps(d: Data) -> DataFrame:
    """Pairs of a target (part) and a site (supplier) of one name whose ranges overlap, each once.

    Targets of one name and the same sizes are a class, and so are sites of the same numbers. Which classes
    meet is found by equality, for a range of six numbers is six of them, and made distinct while it is small;
    a target is in one class and a site in one, so the pairs themselves need no distinct.
    """

    def classed(rows: DataFrame, key: str, number: str, name: str, of: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias(name)).agg(F.sort_array(F.collect_set(number)).alias(of)).withColumn("name", F.col(name) % 10)

    targets = classed(d.part, "p_partkey", "p_size", "target", "sizes")
    sites = classed(d.supplier, "s_suppkey", "s_nationkey", "site", "numbers")
    kinds = targets.groupBy("name", "sizes").agg(F.ceil(F.count("*") / CLASS_SLICE).cast("int").alias("slices"))
    reached = F.flatten(F.transform("numbers", lambda x: F.sequence(x - 2, x + 3)))
    asked = sites.select("name", "numbers").distinct().withColumn("size", F.explode(reached))
    meet = kinds.withColumn("size", F.explode("sizes")).join(asked, ["name", "size"]).select("name", "sizes", "numbers", "slices").distinct()
    met = sites.join(meet, ["name", "numbers"]).select("name", "sizes", "site", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    cut = targets.join(kinds, ["name", "sizes"]).select("name", "sizes", "target", F.pmod(F.xxhash64("target"), F.col("slices")).cast("int").alias("slice"))
    return cut.join(met, ["name", "sizes", "slice"]).select("target", "site")


add(
    "jn15_overlapping_arity",
    "SELECT DISTINCT a.p_partkey AS target, b.s_suppkey AS site FROM part a JOIN supplier b ON a.p_partkey % 10 = b.s_suppkey % 10 AND a.p_size <= b.s_nationkey + 3 AND b.s_nationkey <= a.p_size + 2",
    _overlaps,
)
add(
    "jn16_enrich_top",
    "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) x WHERE place <= 3",
    lambda d: R.top_n(d.orders.join(d.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "place"),
)
add(
    "jn17_cross_store",
    "SELECT v.vec_id, d.lang, d.doc_id IS NULL AS needs_reindex FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id AND d.n_chars > 500",
    lambda d: d.embeddings.select("vec_id").join(d.documents.where("n_chars > 500").select(F.col("doc_id").alias("vec_id"), "lang", F.lit(True).alias("found")), "vec_id", "left").select("vec_id", "lang", F.col("found").isNull().alias("needs_reindex")),
)

# --- aggregations ---------------------------------------------------------------------------------------------

add("ag01_count", "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_regionkey, n_name", lambda d: d.nation.join(d.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count("*").alias("n")))
add("ag02_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", lambda d: d.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")))
add("ag03_conditional_distinct", "SELECT l_linestatus, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END) AS n FROM lineitem GROUP BY l_linestatus", lambda d: d.lineitem.groupBy("l_linestatus").agg(F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("n")))
add("ag04_collect_structs", "SELECT n_regionkey, string_agg(n_name || ':' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey", lambda d: d.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("n_name", "n_nationkey"))), lambda x: F.concat_ws(":", x["n_name"], x["n_nationkey"].cast("string"))), ",").alias("nations")))
add("ag05_card", "SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey", lambda d: d.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("o"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("big"), F.countDistinct("o_orderpriority").alias("priorities")))
add_graph("ag06_graph_statistics", "SELECT label, count(*) AS n FROM nodes GROUP BY ROLLUP (label)", lambda g: g.nodes.rollup("label").agg(F.count("*").alias("n")))
add("ag07_tree", "SELECT r_name, string_agg(n_name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n_name) AS categories, CAST(sum(n) AS BIGINT) AS total FROM (SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name, n_name) x GROUP BY r_name", lambda d: d.region.join(d.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(d.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n")).groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n"))), lambda x: F.concat_ws("=", x["n_name"], x["n"].cast("string"))), ",").alias("categories"), F.sum("n").alias("total")))


def _transitions(d: Data) -> DataFrame:
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return d.events.select(F.col("event_type").alias("caller"), nxt.alias("callee"), "event_id", (F.col("user_id") % 3).alias("kind")).where("callee is not null")


_TRANS = "(SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee, event_id, user_id % 3 AS kind FROM events) t WHERE callee IS NOT NULL"
add(
    "ag08_edge_lines",
    f"SELECT caller, callee, kind, count(*) AS n, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 50), ',') AS lines FROM (SELECT * FROM {_TRANS}) e GROUP BY caller, callee, kind",
    lambda d: R.top_n(_transitions(d), ["caller", "callee", "kind"], ["event_id"], 50).groupBy("caller", "callee", "kind").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("lines"))
    .join(_transitions(d).groupBy("caller", "callee", "kind").agg(F.count("*").alias("n")), ["caller", "callee", "kind"]),
)
add("ag09_last_kind", f"SELECT caller, callee, arg_max(kind, event_id) AS kind FROM (SELECT * FROM {_TRANS}) e GROUP BY caller, callee", lambda d: _transitions(d).groupBy("caller", "callee").agg(F.max_by("kind", "event_id").alias("kind")))
_WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents)"


def _tokens(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))


add("ag10_document_frequency", f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM {_WORDS} w GROUP BY token", lambda d: _tokens(d).groupBy("doc_id", "token").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf")))
add("ag10_corpus_stats", f"SELECT count(DISTINCT doc_id) AS doc_count, count(*) AS total_length FROM {_WORDS} w", lambda d: _tokens(d).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("doc_count"), F.sum("n").alias("total_length")))
#: Documents as they are after two epochs: one in five came, one in eleven lost all but its first line, one in seven went.
_EPOCHS = "SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


def _additive(d: Data) -> DataFrame:
    """Document frequencies after epochs of signed deltas, with the merged totals."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    docs = d.documents.select("doc_id", "text")
    store = PostingStore(d.spark, scratch_path(d.spark, "additive-postings"))
    store.rebuild(docs.where("doc_id % 5 <> 0"), words)
    store.apply(1, docs.where("doc_id % 5 = 0"), words)
    short = docs.where("doc_id % 11 = 1 and doc_id % 7 <> 0").withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1)))
    store.apply(2, short, words, docs.where("doc_id % 7 = 0").select("doc_id"))
    return store.frequencies().crossJoin(F.broadcast(store.totals()))


add(
    "ag10_additive_deltas",
    f"""WITH now AS ({_EPOCHS}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM now), t AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS total FROM w)
    SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf, any_value(docs) AS docs, any_value(total) AS total FROM w, t GROUP BY token""",
    _additive,
)
add(
    "ag11_usage_totals",
    "SELECT event_type, user_id % 5 AS provider, count(*) AS calls, round(sum(value), 4) AS total_value, round(avg(value), 6) AS avg_value, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (event_type), ())",
    lambda d: d.events.withColumn("provider", F.col("user_id") % 5).groupingSets([["event_type", "provider"], ["event_type"], []], "event_type", "provider")
    .agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total_value"), F.round(F.avg("value"), 6).alias("avg_value"), F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("first_us"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us")),
)
add(
    "ag12_running_cap",
    "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS targets FROM (SELECT c_nationkey, c_custkey, sum(length(c_name)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS used FROM customer) x WHERE used <= 90 GROUP BY c_nationkey",
    lambda d: d.customer.withColumn("used", F.sum(F.length("c_name")).over(W.partitionBy("c_nationkey").orderBy("c_custkey"))).where("used <= 90").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")), ",").alias("targets")),
)
add(
    "ag13_pooling",
    """SELECT label, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM (SELECT label, i, sum(x * w) / sum(w) AS v FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS i, 1 + vec_id % 3 AS w FROM embeddings) e GROUP BY label, i) p""",
    lambda d: d.embeddings.select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("v"))
    .select("label", F.col("i").cast("long").alias("i"), F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("label"))), 6).alias("value")),
)
add(
    "ag14_retrieval_metrics",
    """SELECT k, round(avg(hit), 6) AS answer_hit, round(avg(cover), 6) AS coverage FROM (SELECT o_custkey, k, max(CASE WHEN place <= k AND o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS hit, sum(CASE WHEN place <= k AND o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS cover
    FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) r, (VALUES (1), (5), (10)) v(k) GROUP BY o_custkey, k HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 0) m GROUP BY k""",
    lambda d: d.orders.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).withColumn("gold", (F.col("o_orderstatus") == "F").cast("double")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    .withColumn("got", F.when(F.col("place") <= F.col("k"), F.col("gold")).otherwise(0.0)).groupBy("o_custkey", "k").agg(F.max("got").alias("hit"), (F.sum("got") / F.nullif(F.sum("gold"), F.lit(0.0))).alias("cover")).where("cover is not null")
    .groupBy("k").agg(F.round(F.avg("hit"), 6).alias("answer_hit"), F.round(F.avg("cover"), 6).alias("coverage")),
)
_OLD = "(SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0)"
_NEW = "(SELECT doc_id AS k, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h, lang AS grp FROM documents WHERE doc_id % 11 <> 0)"


def versions(d: Data) -> tuple[DataFrame, DataFrame]:
    """Two manifests: an old one, and a new one with changed, dropped and added rows."""
    old = d.documents.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h"))
    new = d.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("k"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"), F.col("lang").alias("grp"))
    return old, new


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """k and state (added, deleted, changed, unchanged) of two keyed hash tables."""
    o, n = old.select("k", F.col("h").alias("old_h")), new.select("k", F.col("h").alias("new_h"))
    state = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "deleted").when(F.col("old_h") != F.col("new_h"), "changed").otherwise("unchanged")
    return o.join(n, "k", "full").select("k", state.alias("state"))


_DIFF = f"(SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS state FROM {_OLD} o FULL JOIN {_NEW} n ON o.k = n.k)"
add("ag15_diff_counters", f"SELECT state, count(*) AS n FROM {_DIFF} d GROUP BY state", lambda d: difference(*versions(d)).groupBy("state").agg(F.count("*").alias("n")))

# --- windows and ranking ------------------------------------------------------------------------------------------

add("wn01_leg_rank", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS leg_rank FROM part", lambda d: d.part.select("p_brand", "p_partkey", (F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long") - 1).alias("leg_rank")))
add("wn02_top_per_key", "SELECT p_type, p_partkey, place FROM (SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part) x WHERE place <= 3", lambda d: R.top_n(d.part, ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_type", "p_partkey", "place"))
add(
    "wn03_normalise",
    "SELECT c_custkey, round(CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0 END, 6) AS scaled, round(CASE WHEN p95 - p50 > 1e-9 THEN least(1, greatest(0, (c_acctbal - p50) / (p95 - p50))) ELSE 0 END, 6) AS robust FROM (SELECT c_custkey, c_acctbal, c_nationkey, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_nationkey)) a JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.95) AS p95 FROM customer GROUP BY c_nationkey) q USING (c_nationkey)",
    lambda d: d.customer.select("c_custkey", "c_acctbal", "c_nationkey", R.min_max("c_acctbal", ["c_nationkey"], 0.0).alias("s")).join(d.customer.groupBy("c_nationkey").agg(F.percentile("c_acctbal", 0.5).alias("p50"), F.percentile("c_acctbal", 0.95).alias("p95")), "c_nationkey")
    .select("c_custkey", F.round("s", 6).alias("scaled"), F.round(F.when(F.col("p95") - F.col("p50") > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("c_acctbal") - F.col("p50")) / (F.col("p95") - F.col("p50"))))).otherwise(0.0), 6).alias("robust")),
)
add(
    "wn04_parent_score",
    "SELECT o_custkey, round(avg(CASE WHEN place <= 3 THEN o_totalprice END) + 1000 * least(count(*), 5), 4) AS score FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders) x GROUP BY o_custkey",
    lambda d: d.orders.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")))).groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("place") <= 3, F.col("o_totalprice"))) + 1000 * F.least(F.count("*"), F.lit(5)), 4).alias("score")),
)
add(
    "wn05_best_window",
    "SELECT o_custkey, o_orderkey AS window_start, round(w, 4) AS window_score FROM (SELECT o_custkey, o_orderkey, w, row_number() OVER (PARTITION BY o_custkey ORDER BY round(w, 4) DESC, o_orderkey) AS k FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM orders) x) y WHERE k = 1",
    lambda d: R.best_window(d.orders, "o_custkey", "o_orderkey", "o_totalprice", 3).select("o_custkey", "window_start", F.round("window_score", 4).alias("window_score")),
)
add(
    "wn06_margin_gate",
    "SELECT o_custkey, round(o_totalprice - nxt, 4) AS margin, coalesce(o_totalprice - nxt >= 20000, true) AS sure FROM (SELECT o_custkey, o_totalprice, lead(o_totalprice) OVER w AS nxt, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) x WHERE k = 1",
    lambda d: (lambda w: d.orders.select("o_custkey", "o_totalprice", F.lead("o_totalprice").over(w).alias("nxt"), F.row_number().over(w).alias("k")).where("k = 1").select("o_custkey", F.round(F.col("o_totalprice") - F.col("nxt"), 4).alias("margin"), F.coalesce(F.col("o_totalprice") - F.col("nxt") >= 20000, F.lit(True)).alias("sure")))(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")),
)
add(
    "wn07_islands",
    "SELECT l_suppkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || '..' || CAST(hi AS VARCHAR) END, '|' ORDER BY lo) AS ranges FROM (SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a) b GROUP BY l_suppkey, g) c GROUP BY l_suppkey",
    lambda d: R.islands(d.lineitem, ["l_suppkey"], "l_partkey").withColumn("t", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")))).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "t"))), lambda x: x["t"]), "|").alias("ranges")),
)
add(
    "wn08_numbered_siblings",
    "SELECT stem, n_regionkey, min(num) AS lo, max(num) AS hi FROM (SELECT regexp_extract(n_name, '^(.*?)([0-9]+)$', 1) AS stem, CAST(regexp_extract(n_name, '^(.*?)([0-9]+)$', 2) AS INTEGER) AS num, n_regionkey, CAST(regexp_extract(n_name, '^(.*?)([0-9]+)$', 2) AS INTEGER) - row_number() OVER (PARTITION BY n_regionkey ORDER BY CAST(regexp_extract(n_name, '^(.*?)([0-9]+)$', 2) AS INTEGER)) AS g FROM nation) x GROUP BY stem, n_regionkey, g",
    lambda d: R.islands(d.nation.select(F.regexp_extract("n_name", "^(.*?)([0-9]+)$", 1).alias("stem"), "n_regionkey", F.regexp_extract("n_name", "^(.*?)([0-9]+)$", 2).cast("int").alias("num")), ["stem", "n_regionkey"], "num"),
)
add(
    "wn09_line_layout",
    "SELECT conv_id, turn, CAST(sum(lines) OVER (PARTITION BY conv_id ORDER BY turn) - lines AS BIGINT) AS start_line, lines FROM (SELECT conv_id, turn, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM conversations) x",
    lambda d: d.conversations.select("conv_id", "turn", F.size(F.split("text", "\n")).cast("long").alias("lines")).withColumn("start_line", F.sum("lines").over(W.partitionBy("conv_id").orderBy("turn")) - F.col("lines")),
)
add(
    "wn10_priority_selection",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, prio, row_number() OVER (PARTITION BY o_custkey ORDER BY prio, o_orderkey) AS k FROM (SELECT o_custkey, o_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END) AS prio FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey) x) y WHERE k <= 4 OR prio = 0",
    lambda d: d.orders.join(d.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "O", 1).otherwise(2)).alias("prio"))
    .withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy("prio", "o_orderkey"))).where("k <= 4 or prio = 0").select("o_custkey", "o_orderkey"),
)

# --- sort, paging, set operations -----------------------------------------------------------------------------------

add("so01_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40", lambda d: R.page(d.customer, [F.desc("c_acctbal"), "c_custkey"], 20, 40)[0].select("c_custkey", "c_name"))
add("so03_cursor", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 = 0) ORDER BY p_retailprice DESC, p_partkey LIMIT 50", lambda d: R.without(d.part, d.part.where("p_partkey % 5 = 0"), "p_partkey").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey"))
_LEGS = """legs AS (SELECT s_nationkey AS q, s_suppkey AS id, 'a' AS leg, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier
    UNION ALL SELECT s_nationkey, s_suppkey, 'b', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0)"""


def _pages(d: Data) -> DataFrame:
    """Pages of fused legs with a conservative has_more; each leg may hold four rows, a page ends at three."""
    a = R.top_n(d.supplier.select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("id"), "s_acctbal"), ["q"], [F.desc("s_acctbal"), "id"], 4).select("q", "id")
    b = R.top_n(d.supplier.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("id"), "s_name"), ["q"], ["s_name", "id"], 4).select("q", "id")
    return R.has_more([a, b], "q", "id", 4, 3)


add(
    "so02_conservative_has_more",
    f"WITH {_LEGS} SELECT q, count(DISTINCT id) AS pool, CASE WHEN max(full_leg) = 1 THEN count(DISTINCT id) >= 3 ELSE count(DISTINCT id) > 3 END AS has_more FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY q, leg) >= 4 THEN 1 ELSE 0 END AS full_leg FROM legs WHERE k <= 4) x GROUP BY q",
    _pages,
)
add(
    "pr08_clamped_page",
    "SELECT user_id, CAST(least(500, greatest(1, coalesce(TRY_CAST(raw AS INTEGER), 50))) AS INTEGER) AS page_limit, CAST(greatest(0, coalesce(TRY_CAST(raw AS INTEGER), 0)) AS INTEGER) AS page_offset FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'x' || user_id WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(-user_id AS VARCHAR) END AS raw FROM events) r",
    lambda d: d.events.select("user_id").distinct().withColumn("raw", F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"))).when(F.col("user_id") % 4 == 1, F.col("user_id").cast("string")).when(F.col("user_id") % 4 == 2, (-F.col("user_id")).cast("string")))
    .select("user_id", R.clamped("raw", 1, 500, 50).alias("page_limit"), R.clamped("raw", 0, None, 0).alias("page_offset")),
)
add_graph(
    "so04_path_units",
    "SELECT path_no, hop, node FROM (SELECT row_number() OVER (ORDER BY a.src, a.dst, b.dst) AS path_no, [a.src, a.dst, b.dst] AS path FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'HAS_TABULAR_PART' AND b.rel = 'HAS_ATTRIBUTE' QUALIFY path_no BETWEEN 11 AND 30) p, (SELECT unnest(p.path) AS node, unnest(range(0, 3)) AS hop) u",
    lambda g: g.links("HAS_TABULAR_PART").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(g.links("HAS_ATTRIBUTE").select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
    .orderBy("a", "b", "c").limit(30).withColumn("path_no", F.row_number().over(W.orderBy("a", "b", "c")).cast("long")).where("path_no > 10").select("path_no", F.posexplode(F.array("a", "b", "c")).alias("hop", "node")).select("path_no", F.col("hop").cast("long").alias("hop"), "node"),
)
add("so05_union", "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION SELECT s_nationkey, 's' FROM supplier UNION SELECT n_nationkey, 'n' FROM nation", lambda d: d.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("t")).union(d.supplier.select("s_nationkey", F.lit("s"))).union(d.nation.select("n_nationkey", F.lit("n"))).distinct())
add("so06_union_max", "SELECT k, max(score) AS score, count(*) OVER () AS total FROM (SELECT p_partkey AS k, 2 AS score FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 3 FROM part WHERE p_retailprice > 1500) x GROUP BY k", lambda d: (lambda u: u.crossJoin(F.broadcast(u.agg(F.count("*").alias("total")))))(d.part.where("p_size > 40").select(F.col("p_partkey").alias("k"), F.lit(2).alias("score")).unionByName(d.part.where("p_retailprice > 1500").select(F.col("p_partkey").alias("k"), F.lit(3).alias("score"))).groupBy("k").agg(F.max("score").alias("score"))))
add("so07_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", lambda d: d.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct())
add("so08_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier", lambda d: d.customer.select(F.col("c_nationkey").alias("k")).subtract(d.supplier.select("s_nationkey")))
add("so08_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", lambda d: d.customer.select(F.col("c_nationkey").alias("k")).intersect(d.supplier.select("s_nationkey")))
add(
    "so09_quota_interleave",
    "SELECT p_partkey, slot FROM (SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN r <= CASE g WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS INTEGER) AS slot FROM (SELECT p_partkey, p_retailprice, g, row_number() OVER (PARTITION BY g ORDER BY p_retailprice DESC, p_partkey) AS r FROM (SELECT p_partkey, p_retailprice, dense_rank() OVER (ORDER BY p_brand) AS g FROM part WHERE p_size < 10) a) b) c WHERE slot <= 8",
    lambda d: R.interleave(
        d.part.where("p_size < 10").join(F.broadcast(d.part.where("p_size < 10").select("p_brand").distinct().withColumn("g", F.row_number().over(W.orderBy("p_brand")))), "p_brand").withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.desc("p_retailprice"), "p_partkey"))),
        "g", "r", [3, 1, 1], 8, [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "slot"),
)
add("so10_merge_legs", "SELECT user_id, arg_max(event_type, value * 1000000000 + event_id) AS best, round(max(value), 6) AS score FROM events GROUP BY user_id", lambda d: d.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("best"), F.round(F.max("value"), 6).alias("score")))
