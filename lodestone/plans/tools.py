"""The typed query tools, one registered query for each mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import paths as P
from lodestone.plans.registry import register
from lodestone.session import materialise
from lodestone.sources.projection import ENDS, KINDS, Graph, duck


def _add(name: str, sql: str, build) -> None:
    register(name, duck(sql))(lambda spark, sf_dir: build(Graph(spark, sf_dir)))


def _like(column: str, needle: str, mode: str = "exact") -> str:
    n = needle.lower()
    return {"exact": f"lower({column}) = '{n}'", "starts_with": f"starts_with(lower({column}), '{n}')", "contains": f"contains(lower({column}), '{n}')"}[mode]


# --- Q-01: configurations, categories, objects, summary -----------------------------------------

_add(
    "q01_summary",
    "SELECT config_name, category_name, count(*) AS objects FROM nodes WHERE label = 'MetadataObject' GROUP BY config_name, category_name",
    lambda g: g.of("MetadataObject").groupBy("config_name", "category_name").agg(F.count("*").alias("objects")),
)
_add(
    "q01_configurations",
    "SELECT qn, name, is_extension FROM nodes WHERE label = 'Configuration'",
    lambda g: g.of("Configuration").select("qn", "name", "is_extension"),
)
_add(
    "q01_categories",
    "SELECT c.qn, c.name, f.name AS configuration FROM nodes c JOIN nodes f ON c.owner_qn = f.qn WHERE c.label = 'MetadataCategory' AND f.label = 'Configuration'",
    lambda g: g.of("MetadataCategory").alias("c")
    .join(g.of("Configuration").alias("f"), F.col("c.owner_qn") == F.col("f.qn"))
    .select("c.qn", "c.name", F.col("f.name").alias("configuration")),
)


def _only_adopted(g: Graph) -> DataFrame:
    adopted = g.links("ADOPTED_FROM").where("dst_label = 'MetadataObject'")
    ends = adopted.select(F.col("src").alias("qn")).unionByName(adopted.select(F.col("dst").alias("qn")))
    return g.of("MetadataObject").join(ends, "qn", "left_semi").select("qn", "name", "config_name", "category_name")


_add(
    "q01_objects",
    "SELECT qn, name, config_name, category_name FROM nodes WHERE label = 'MetadataObject' AND qn IN (SELECT src FROM edges WHERE rel = 'ADOPTED_FROM' UNION SELECT dst FROM edges WHERE rel = 'ADOPTED_FROM')",
    _only_adopted,
)

# --- Q-02: objects by what they have ---------------------------------------------------------------

_OWNER = "SELECT DISTINCT o.qn AS owner_qn, o.name AS owner_name, o.config_name AS owner_config_name, o.category_name AS owner_category_name"
OWNER_MODES = {
    "attribute": ("HAS_ATTRIBUTE", "Attribute_12", "exact"),
    "tabular_part": ("HAS_TABULAR_PART", "TabularPart_1", "starts_with"),
    "resource": ("HAS_RESOURCE", "resource_14", "exact"),
    "dimension": ("HAS_DIMENSION", "_3", "contains"),
    "command": ("HAS_COMMAND", "Command_5", "starts_with"),
    "layout": ("HAS_LAYOUT", "Layout_6", "exact"),
    "predefined_name": ("HAS_PREDEFINED", "PredefinedItem_7", "exact"),
    "journal_graph": ("HAS_GRAPH", "JournalGraph_8", "exact"),
}
for _mode, (_rel, _needle, _how) in OWNER_MODES.items():
    _add(
        f"q02_{_mode}",
        f"{_OWNER} FROM edges e JOIN nodes c ON e.dst = c.qn JOIN nodes o ON e.src = o.qn WHERE e.rel = '{_rel}' AND o.label = 'MetadataObject' AND {_like('c.name', _needle, _how)}",
        lambda g, r=_rel, n=_needle, h=_how: G.owners(g.around(r), g.links(r), r, n, h),
    )


def _two_hop_owners(g: Graph, rel: str, middle: str, rel2: str, needle: str, how: str) -> DataFrame:
    leaf = g.targets(rel2).where(G.match("name", needle, how)).select(F.col("qn").alias("leaf"))
    inner = g.links(rel2).select(F.col("src").alias("mid"), F.col("dst").alias("leaf")).join(leaf, "leaf")
    outer = g.links(rel).select(F.col("src"), F.col("dst").alias("mid")).join(inner, "mid")
    owner = G.renamed(g.of("MetadataObject"), "owner", "qn", "name", "config_name", "category_name")
    return outer.join(owner, F.col("src") == F.col("owner_qn")).select("owner_qn", "owner_name", "owner_config_name", "owner_category_name").distinct()


TWO_HOP = {
    "tabular_attribute": ("HAS_TABULAR_PART", "TabularPart", "HAS_ATTRIBUTE", "Attribute_2", "starts_with"),
    "form_attribute": ("HAS_FORM", "Form", "HAS_FORM_ATTRIBUTE", "FormAttribute_1", "starts_with"),
    "form_event": ("HAS_FORM", "Form", "HAS_EVENT", "FormEvent_3", "starts_with"),
}
for _mode, (_rel, _mid, _rel2, _needle, _how) in TWO_HOP.items():
    _add(
        f"q02_{_mode}",
        f"{_OWNER} FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes c ON b.dst = c.qn JOIN nodes o ON a.src = o.qn WHERE a.rel = '{_rel}' AND b.rel = '{_rel2}' AND o.label = 'MetadataObject' AND {_like('c.name', _needle, _how)}",
        lambda g, r=_rel, m=_mid, r2=_rel2, n=_needle, h=_how: _two_hop_owners(g, r, m, r2, n, h),
    )

_add(
    "q02_form",
    f"{_OWNER} FROM edges e JOIN nodes c ON e.dst = c.qn JOIN nodes o ON e.src = o.qn WHERE e.rel = 'HAS_FORM' AND e.flag AND e.kind_text = 'O' AND {_like('c.name', 'Form_', 'starts_with')}",
    lambda g: g.links("HAS_FORM").where("flag and kind_text = 'O'").select("src", "dst")
    .join(g.targets("HAS_FORM").where(G.match("name", "Form_", "starts_with")).select(F.col("qn").alias("dst")), "dst")
    .join(G.renamed(g.sources("HAS_FORM"), "owner", "qn", "name", "config_name", "category_name"), F.col("src") == F.col("owner_qn"))
    .select("owner_qn", "owner_name", "owner_config_name", "owner_category_name").distinct(),
)

_CONTROL_TREE = """WITH RECURSIVE tree AS (SELECT e.src AS form, e.dst AS node, 1 AS depth FROM edges e WHERE e.rel = 'HAS_CONTROL'
    UNION ALL SELECT t.form, e.dst, t.depth + 1 FROM tree t JOIN edges e ON e.src = t.node AND e.rel = 'HAS_CHILD')"""


def _recursive(sql: str) -> str:
    """The control tree as a recursive expression beside the projection's."""
    text = duck("SELECT 0")
    return text[: text.rindex(" SELECT 0")].replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CONTROL_TREE.removeprefix("WITH RECURSIVE ") + " " + sql


def _controls(g: Graph) -> DataFrame:
    """(form, node, depth) of every control below its form."""
    roots = materialise(g.links("HAS_CONTROL").select(F.col("src").alias("form"), F.col("dst").alias("root")), "roots")
    tree = G.closure(g.links("HAS_CHILD"), ["HAS_CHILD"], roots.select(F.col("root").alias("qn")).distinct())
    return tree.join(roots, "root").select("form", "node", (F.col("depth") + 1).alias("depth"))


def _add_recursive(name: str, sql: str, build) -> None:
    register(name, _recursive(sql))(lambda spark, sf_dir: build(Graph(spark, sf_dir)))


_add_recursive(
    "q02_form_control",
    f"SELECT DISTINCT o.qn AS owner_qn, t.form AS form_qn FROM tree t JOIN nodes c ON t.node = c.qn JOIN edges h ON h.dst = t.form AND h.rel = 'HAS_FORM' JOIN nodes o ON h.src = o.qn WHERE {_like('c.name', 'FormControl_1', 'starts_with')}",
    lambda g: _controls(g).join(g.of("FormControl").where(G.match("name", "FormControl_1", "starts_with")).select(F.col("qn").alias("node")), "node")
    .join(g.links("HAS_FORM").select(F.col("src").alias("owner_qn"), F.col("dst").alias("form")), "form")
    .join(g.sources("HAS_FORM").select(F.col("qn").alias("owner_qn")), "owner_qn").select("owner_qn", F.col("form").alias("form_qn")).distinct(),
)

# --- Q-03: sections of an object's structure, with adoption ------------------------------------------

SECTIONS = {
    "attributes": "HAS_ATTRIBUTE", "tabular_parts": "HAS_TABULAR_PART", "resources": "HAS_RESOURCE", "dimensions": "HAS_DIMENSION",
    "forms": "HAS_FORM", "commands": "HAS_COMMAND", "layouts": "HAS_LAYOUT", "enum_values": "HAS_ENUM_VALUE",
    "journal_graphs": "HAS_GRAPH", "url_templates": "HAS_URL_TEMPLATE", "characteristics": "HAS_CHARACTERISTIC",
}
_CATEGORY = "NATION_3"


def _section(g: Graph, rel: str) -> DataFrame:
    objects = g.of("MetadataObject").where(F.col("category_name") == _CATEGORY).select(F.col("qn").alias("src"))
    items = g.targets(rel).select(F.col("qn").alias("dst"), "name", "type_text")
    base = g.links("ADOPTED_FROM").where(F.col("dst_label").isin(list(ENDS[rel][1]))).select(F.col("src").alias("dst"), F.col("dst").alias("adopted_from"))
    hop = g.links(rel).select("src", "dst", F.col("kind_text").alias("role"), F.col("flag").alias("is_default"))
    return hop.join(objects, "src").join(items, "dst").join(base, "dst", "left").select(
        F.col("src").alias("owner_qn"), F.col("dst").alias("qn"), "name", "type_text", "role", "is_default", "adopted_from"
    )


for _name, _rel in SECTIONS.items():
    _add(
        f"q03_{_name}",
        f"""SELECT e.src AS owner_qn, c.qn, c.name, c.type_text, e.kind_text AS role, e.flag AS is_default, a.dst AS adopted_from
        FROM edges e JOIN nodes o ON e.src = o.qn AND o.label = 'MetadataObject' AND o.category_name = '{_CATEGORY}' JOIN nodes c ON e.dst = c.qn
        LEFT JOIN edges a ON a.src = c.qn AND a.rel = 'ADOPTED_FROM' WHERE e.rel = '{_rel}'""",
        lambda g, r=_rel: _section(g, r),
    )
_add(
    "q03_default_forms",
    f"SELECT e.src AS owner_qn, e.dst AS qn, e.kind_text AS role FROM edges e JOIN nodes o ON e.src = o.qn WHERE e.rel = 'HAS_FORM' AND e.flag AND o.category_name = '{_CATEGORY}'",
    lambda g: _section(g, "HAS_FORM").where("is_default").select("owner_qn", "qn", "role"),
)
_add(
    "q03_predefined",
    f"SELECT c.qn, c.name, CAST(c.num AS VARCHAR) AS code, coalesce(c.note, c.type_text, '') AS description FROM edges e JOIN nodes o ON e.src = o.qn JOIN nodes c ON e.dst = c.qn WHERE e.rel = 'HAS_PREDEFINED' AND o.category_name = '{_CATEGORY}'",
    lambda g: G.expand(g.around("HAS_PREDEFINED"), g.links("HAS_PREDEFINED"), "HAS_PREDEFINED").where(F.col("owner_category_name") == _CATEGORY)
    .select(F.col("item_qn").alias("qn"), F.col("item_name").alias("name"), F.col("item_num").cast("string").alias("code"), F.coalesce("item_note", "item_type_text", F.lit("")).alias("description")),
)


def _chain(g: Graph, rel: str, rel2: str) -> DataFrame:
    a = g.links(rel).select(F.col("src").alias("owner_qn"), F.col("dst").alias("part_qn"))
    b = g.links(rel2).select(F.col("src").alias("part_qn"), F.col("dst").alias("qn"))
    return a.join(b, "part_qn").join(g.targets(rel2).select("qn", "name", "type_text"), "qn").select("owner_qn", "part_qn", "qn", "name", "type_text")


for _name, _rel, _rel2 in (("tabular_attributes", "HAS_TABULAR_PART", "HAS_ATTRIBUTE"), ("url_methods", "HAS_URL_TEMPLATE", "HAS_URL_METHOD")):
    _add(
        f"q03_{_name}",
        f"SELECT a.src AS owner_qn, a.dst AS part_qn, c.qn, c.name, c.type_text FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes c ON b.dst = c.qn WHERE a.rel = '{_rel}' AND b.rel = '{_rel2}'",
        lambda g, r=_rel, r2=_rel2: _chain(g, r, r2),
    )


def _overview(g: Graph) -> DataFrame:
    """Names of each kind of child as sorted lists, tabular parts with their columns."""
    parts = g.links("HAS_ATTRIBUTE", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_TABULAR_PART").select("src", "rel", "dst")
    rows = parts.join(g.targets("HAS_ATTRIBUTE", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_TABULAR_PART").select(F.col("qn").alias("dst"), "name"), "dst")
    owner = g.of("MetadataObject").where(F.col("category_name") == _CATEGORY).select(F.col("qn").alias("src"))
    cell = lambda rel: F.array_join(F.array_sort(F.collect_set(F.when(F.col("rel") == rel, F.col("name")))), ",")
    return owner.join(rows, "src", "left").groupBy(F.col("src").alias("owner_qn")).agg(
        cell("HAS_ATTRIBUTE").alias("attributes"), cell("HAS_RESOURCE").alias("resources"), cell("HAS_DIMENSION").alias("dimensions"), cell("HAS_TABULAR_PART").alias("tabular_parts")
    )


def _names(rel: str) -> str:
    return f"coalesce(string_agg(DISTINCT CASE WHEN e.rel = '{rel}' THEN c.name END, ',' ORDER BY CASE WHEN e.rel = '{rel}' THEN c.name END), '')"


_add(
    "q03_overview",
    f"""SELECT o.qn AS owner_qn, {_names('HAS_ATTRIBUTE')} AS attributes, {_names('HAS_RESOURCE')} AS resources, {_names('HAS_DIMENSION')} AS dimensions, {_names('HAS_TABULAR_PART')} AS tabular_parts
    FROM nodes o LEFT JOIN edges e ON e.src = o.qn AND e.rel IN ('HAS_ATTRIBUTE', 'HAS_RESOURCE', 'HAS_DIMENSION', 'HAS_TABULAR_PART') LEFT JOIN nodes c ON e.dst = c.qn
    WHERE o.label = 'MetadataObject' AND o.category_name = '{_CATEGORY}' GROUP BY o.qn""",
    _overview,
)

# --- Q-04: elements with their owners ------------------------------------------------------------------

ELEMENTS = {
    "attribute": ("HAS_ATTRIBUTE", "Attribute_2", "starts_with"),
    "attributes_of_matching_objects": ("HAS_ATTRIBUTE", "", "contains"),
    "form": ("HAS_FORM", "Form_4", "starts_with"),
    "command": ("HAS_COMMAND", "Command_", "contains"),
    "layout": ("HAS_LAYOUT", "Layout_18", "exact"),
    "journal_graph": ("HAS_GRAPH", "JournalGraph_2", "starts_with"),
    "form_attribute": ("HAS_FORM_ATTRIBUTE", "FormAttribute_", "contains"),
    "tabular_attribute": ("HAS_ATTRIBUTE", "Attribute_3", "starts_with"),
}
for _mode, (_rel, _needle, _how) in ELEMENTS.items():
    _who = {"attributes_of_matching_objects": "label = 'MetadataObject' AND contains(lower(name), '7')", "tabular_attribute": "label = 'TabularPart'"}.get(_mode, "label <> ''")
    _add(
        f"q04_{_mode}",
        f"SELECT DISTINCT o.qn AS owner_qn, o.name AS owner_name, c.qn AS item_qn, c.name AS item_name, e.kind_text AS role, e.flag AS is_default FROM edges e JOIN (SELECT * FROM nodes WHERE {_who}) o ON e.src = o.qn JOIN nodes c ON e.dst = c.qn WHERE e.rel = '{_rel}' AND {_like('c.name', _needle, _how)}",
        lambda g, r=_rel, n=_needle, h=_how, w=_who: g.links(r)
        .join(G.renamed(g.sources(r).where(w), "owner", "qn", "name"), F.col("src") == F.col("owner_qn"))
        .join(G.renamed(g.targets(r).where(G.match("name", n, h)), "item", "qn", "name"), F.col("dst") == F.col("item_qn"))
        .select("owner_qn", "owner_name", "item_qn", "item_name", F.col("kind_text").alias("role"), F.col("flag").alias("is_default")).distinct(),
    )

# --- Q-05: usages ---------------------------------------------------------------------------------------

TYPED = ("HAS_ATTRIBUTE", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_TABULAR_PART", "HAS_FORM", "HAS_COMMAND", "HAS_LAYOUT", "HAS_GRAPH")


def _usage_objects(g: Graph, needle: str) -> DataFrame:
    """Objects with any typed element whose type list holds the needle."""
    hit = F.exists(F.split("type_text", ","), lambda t: F.lower(t).contains(needle))
    typed = g.targets(*TYPED).where(hit).select(F.col("qn").alias("dst"))
    used = g.links(*TYPED).select("src", "dst").join(typed, "dst").select(F.col("src").alias("qn")).distinct()
    return g.of("MetadataObject").select("qn", "name", "category_name").join(used, "qn", "left_semi")


_add(
    "q05_objects",
    f"""SELECT DISTINCT o.qn, o.name, o.category_name FROM edges e JOIN nodes c ON e.dst = c.qn JOIN nodes o ON e.src = o.qn
    WHERE e.rel IN {TYPED} AND o.label = 'MetadataObject' AND len(list_filter(string_split(c.type_text, ','), lambda t: contains(lower(t), 'urgent'))) > 0""",
    lambda g: _usage_objects(g, "urgent"),
)
_add(
    "q05_paths",
    """SELECT DISTINCT replace(u.dst, '/', '.') AS usage_path, t.label AS element_label FROM edges u JOIN nodes s ON u.src = s.qn JOIN nodes t ON u.dst = t.qn WHERE u.rel = 'USED_IN' AND s.num <= 3""",
    lambda g: g.links("USED_IN").select("src", "dst")
    .join(g.sources("USED_IN").where("num <= 3").select(F.col("qn").alias("src")), "src").join(g.targets("USED_IN").select(F.col("qn").alias("dst"), "label"), "dst")
    .select(F.concat_ws(".", F.split("dst", "/")).alias("usage_path"), F.col("label").alias("element_label")).distinct(),
)
_add(
    "q05_register_movements",
    "SELECT e.dst AS register_qn, d.qn AS document_qn, d.category_name FROM edges e JOIN nodes d ON e.src = d.qn WHERE e.rel = 'DO_MOVEMENTS_IN' AND d.label = 'MetadataObject'",
    lambda g: g.links("DO_MOVEMENTS_IN").select("src", F.col("dst").alias("register_qn"))
    .join(g.of("MetadataObject").select(F.col("qn").alias("src"), "category_name"), "src").select("register_qn", F.col("src").alias("document_qn"), "category_name"),
)

# --- Q-06: types of elements -----------------------------------------------------------------------------

TYPES = {
    "attribute": ("HAS_ATTRIBUTE", "num % 3 <> 0"), "addressing_attribute": ("HAS_ATTRIBUTE", "num % 3 = 0"), "resource": ("HAS_RESOURCE", "num is not null"),
    "dimension": ("HAS_DIMENSION", "num is not null"), "accounting_flag": ("HAS_ENUM_VALUE", "num % 2 = 0"), "dimension_accounting_flag": ("HAS_ENUM_VALUE", "num % 2 = 1"),
    "tabular_attribute": ("HAS_ATTRIBUTE", "qn like '%/TabularPart/%'"), "form_attribute": ("HAS_FORM_ATTRIBUTE", "num is not null"),
}
for _mode, (_rel, _cond) in TYPES.items():
    _add(
        f"q06_{_mode}",
        f"SELECT e.src AS container_qn, string_agg(DISTINCT c.name || ':' || c.type_text, ';' ORDER BY c.name || ':' || c.type_text) AS element_types, count(*) AS elements FROM edges e JOIN (SELECT * FROM nodes WHERE {_cond}) c ON e.dst = c.qn WHERE e.rel = '{_rel}' GROUP BY e.src",
        lambda g, r=_rel, c=_cond: g.links(r).select(F.col("src").alias("container_qn"), "dst")
        .join(g.targets(r).where(c).select(F.col("qn").alias("dst"), F.concat_ws(":", "name", "type_text").alias("typed")), "dst").groupBy("container_qn")
        .agg(F.array_join(F.array_sort(F.collect_set("typed")), ";").alias("element_types"), F.count("*").alias("elements")),
    )

# --- Q-07: predefined values --------------------------------------------------------------------------------

_PRE = "SELECT e.src AS owner_qn, c.qn, c.name FROM edges e JOIN nodes c ON e.dst = c.qn WHERE e.rel = 'HAS_PREDEFINED'"


def _predefined(g: Graph, condition) -> DataFrame:
    return g.links("HAS_PREDEFINED").join(g.targets("HAS_PREDEFINED").where(condition).select("qn", "name"), F.col("dst") == F.col("qn")).select(F.col("src").alias("owner_qn"), "qn", "name")


_add("q07_name", f"{_PRE} AND {_like('c.name', 'predefineditem_1', 'starts_with')}", lambda g: _predefined(g, G.match("name", "PredefinedItem_1", "starts_with")))
_add("q07_flag", f"{_PRE} AND coalesce(c.num % 4 = 3, false) = true", lambda g: _predefined(g, F.coalesce(F.col("num") % 4 == 3, F.lit(False))))
_add("q07_account_type", f"{_PRE} AND lower(c.note) = 'f'", lambda g: _predefined(g, F.lower("note") == "f"))
_add(
    "q07_subconto_type",
    "SELECT e.src AS owner_qn, c.qn, k.kind FROM edges e JOIN nodes c ON e.dst = c.qn, unnest(string_split(c.type_text, '.')) AS k(kind) WHERE e.rel = 'HAS_PREDEFINED' AND k.kind <> 'SupplierRef'",
    lambda g: g.links("HAS_PREDEFINED").join(g.targets("HAS_PREDEFINED").select("qn", F.explode(F.split("type_text", r"\.")).alias("kind")), F.col("dst") == F.col("qn"))
    .where("kind <> 'SupplierRef'").select(F.col("src").alias("owner_qn"), "qn", "kind"),
)

# --- Q-08: access rights ---------------------------------------------------------------------------------------

_RIGHTS = ("Read", "Insert", "View")


def _grants(g: Graph) -> DataFrame:
    held = F.array_compact(F.array(*[F.when(F.array_contains(F.split("kind_text", ","), r), F.lit(r)) for r in _RIGHTS]))
    return g.links("GRANTS_ACCESS_TO").select(F.col("src").alias("role_qn"), F.col("dst").alias("target_qn"), F.array_join(held, "+").alias("rights"), F.col("flag").alias("has_condition"))


_GRANTED = "SELECT src AS role_qn, dst AS target_qn, concat_ws('+', CASE WHEN list_contains(string_split(kind_text, ','), 'Read') THEN 'Read' END, CASE WHEN list_contains(string_split(kind_text, ','), 'Insert') THEN 'Insert' END, CASE WHEN list_contains(string_split(kind_text, ','), 'View') THEN 'View' END) AS rights, flag AS has_condition FROM edges WHERE rel = 'GRANTS_ACCESS_TO'"
_add("q08_roles_for_target", f"{_GRANTED} AND ends_with(dst, '1')", lambda g: _grants(g).where(F.col("target_qn").endswith("1")))
_add("q08_targets_of_role", f"{_GRANTED} AND src = 'tpch/Roles/NATION_4'", lambda g: _grants(g).where("role_qn = 'tpch/Roles/NATION_4'"))
_add("q08_role_rights_to_target", f"{_GRANTED} AND flag", lambda g: _grants(g).where("has_condition"))

# --- Q-09: details -------------------------------------------------------------------------------------------------

_add(
    "q09_resolve",
    "SELECT qn, label, name FROM nodes WHERE qn = 'tpch/EXT_ASIA' OR starts_with(qn, 'tpch/EXT_ASIA/')",
    lambda g: g.nodes.where(G.subtree("qn", "tpch/EXT_ASIA")).select("qn", "label", "name"),
)


def _properties(g: Graph) -> DataFrame:
    props = F.create_map(*[x for c in ("name", "type_text", "note", "owner_qn") for x in (F.lit(c), F.col(c))])
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & (v != "") & ~k.isin("owner_qn"))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return g.nodes.select("qn", "label", F.array_join(pairs, ";").alias("properties"))


_add(
    "q09_properties",
    "SELECT qn, label, concat_ws(';', 'name=' || name, CASE WHEN note <> '' THEN 'note=' || note END, CASE WHEN type_text <> '' THEN 'type_text=' || type_text END) AS properties FROM nodes",
    _properties,
)

# --- Q-10, Q-11: forms ------------------------------------------------------------------------------------------------

_add_recursive(
    "q10_controls",
    "SELECT t.form AS form_qn, t.node AS qn, t.depth, p.src AS parent_qn FROM tree t LEFT JOIN edges p ON p.dst = t.node AND p.rel = 'HAS_CHILD'",
    lambda g: _controls(g).join(g.links("HAS_CHILD").select(F.col("dst").alias("node"), F.col("src").alias("parent_qn")), "node", "left")
    .select(F.col("form").alias("form_qn"), F.col("node").alias("qn"), "depth", "parent_qn"),
)
for _name, _rel in (("bindings", "BINDS_TO"), ("command_usages", "LINKS_TO_COMMAND")):
    _add_recursive(
        f"q10_{_name}",
        f"SELECT t.form AS form_qn, t.node AS control_qn, e.dst AS target_qn FROM tree t JOIN edges e ON e.src = t.node WHERE e.rel = '{_rel}'",
        lambda g, r=_rel: _controls(g).join(g.links(r).select(F.col("src").alias("node"), F.col("dst").alias("target_qn")), "node")
        .select(F.col("form").alias("form_qn"), F.col("node").alias("control_qn"), "target_qn"),
    )
for _name, _rel in (("attributes", "HAS_FORM_ATTRIBUTE"), ("commands", "HAS_COMMAND")):
    _add(
        f"q10_{_name}",
        f"SELECT o.qn AS form_qn, c.qn, c.name, c.type_text FROM edges e JOIN nodes o ON e.src = o.qn AND o.label = 'Form' JOIN nodes c ON e.dst = c.qn WHERE e.rel = '{_rel}'",
        lambda g, r=_rel: G.expand(g.around(r), g.links(r), r, "form").where("form_label = 'Form'")
        .select("form_qn", F.col("item_qn").alias("qn"), F.col("item_name").alias("name"), F.col("item_type_text").alias("type_text")),
    )
_add(
    "q10_events",
    "SELECT e.src AS form_qn, e.dst AS event_qn, a.dst AS action_qn FROM edges e LEFT JOIN edges a ON a.src = e.dst AND a.rel = 'HAS_EVENT_ACTION' WHERE e.rel = 'HAS_EVENT'",
    lambda g: g.links("HAS_EVENT").select(F.col("src").alias("form_qn"), F.col("dst").alias("event_qn"))
    .join(g.links("HAS_EVENT_ACTION").select(F.col("src").alias("event_qn"), F.col("dst").alias("action_qn")), "event_qn", "left").select("form_qn", "event_qn", "action_qn"),
)
_add(
    "q10_event_handlers",
    "SELECT m.src AS owner_qn, m.dst AS source_qn, h.dst AS routine_qn FROM edges m JOIN edges h ON h.src = m.dst AND h.rel = 'HAS_HANDLER' WHERE m.rel = 'HAS_URL_METHOD'",
    lambda g: g.links("HAS_URL_METHOD").select(F.col("src").alias("owner_qn"), F.col("dst").alias("source_qn"))
    .join(g.links("HAS_HANDLER").select(F.col("src").alias("source_qn"), F.col("dst").alias("routine_qn")), "source_qn").select("owner_qn", "source_qn", "routine_qn"),
)
_add_recursive(
    "q11_controls_bound_to",
    f"SELECT t.form AS form_qn, t.node AS control_qn, a.name AS target_name FROM tree t JOIN edges b ON b.src = t.node AND b.rel = 'BINDS_TO' JOIN nodes a ON b.dst = a.qn WHERE {_like('a.name', 'FormAttribute_2', 'starts_with')}",
    lambda g: _controls(g).join(g.links("BINDS_TO").select(F.col("src").alias("node"), "dst"), "node")
    .join(g.targets("BINDS_TO").where(G.match("name", "FormAttribute_2", "starts_with")).select(F.col("qn").alias("dst"), F.col("name").alias("target_name")), "dst")
    .select(F.col("form").alias("form_qn"), F.col("node").alias("control_qn"), "target_name"),
)
_add(
    "q11_events_handled_by_routine",
    "SELECT h.src AS source_qn, h.rel, r.name AS routine_name FROM edges h JOIN nodes r ON h.dst = r.qn WHERE h.rel IN ('HAS_HANDLER', 'USES_HANDLER') AND r.name = 'Routine_7' UNION SELECT h.src, h.rel, r.name FROM edges h JOIN nodes r ON h.dst = r.qn WHERE h.rel = 'HAS_HANDLER' AND r.name = 'Routine_8'",
    lambda g: g.links("HAS_HANDLER", "USES_HANDLER").join(g.of("Routine").where("name = 'Routine_7'").select("qn", "name"), F.col("dst") == F.col("qn"))
    .select(F.col("src").alias("source_qn"), "rel", F.col("name").alias("routine_name"))
    .union(g.links("HAS_HANDLER").join(g.of("Routine").where("name = 'Routine_8'").select("qn", "name"), F.col("dst") == F.col("qn")).select("src", "rel", "name")).distinct(),
)

# --- Q-12: event subscriptions --------------------------------------------------------------------------------------------

_add("q12_list", "SELECT qn, name, note AS event FROM nodes WHERE label = 'EventSubscription'", lambda g: g.of("EventSubscription").select("qn", "name", F.col("note").alias("event")))
_add(
    "q12_of_object",
    "SELECT e.src AS object_qn, s.qn, s.name FROM edges e JOIN nodes s ON e.dst = s.qn WHERE e.rel = 'HAS_EVENT_SUBSCRIPTION'",
    lambda g: g.links("HAS_EVENT_SUBSCRIPTION").join(g.targets("HAS_EVENT_SUBSCRIPTION").select("qn", "name"), F.col("dst") == F.col("qn")).select(F.col("src").alias("object_qn"), "qn", "name"),
)
_add(
    "q12_sources",
    "SELECT n.qn, k.source FROM nodes n, unnest(string_split(n.type_text, ',')) AS k(source) WHERE n.label = 'EventSubscription'",
    lambda g: g.of("EventSubscription").select("qn", F.explode(F.split("type_text", ",")).alias("source")),
)
_add(
    "q12_handlers",
    "SELECT e.src AS object_qn, e.dst AS subscription_qn, h.dst AS routine_qn FROM edges e JOIN edges h ON h.src = e.dst AND h.rel = 'USES_HANDLER' WHERE e.rel = 'HAS_EVENT_SUBSCRIPTION'",
    lambda g: g.links("HAS_EVENT_SUBSCRIPTION").select(F.col("src").alias("object_qn"), F.col("dst").alias("subscription_qn"))
    .join(g.links("USES_HANDLER").select(F.col("src").alias("subscription_qn"), F.col("dst").alias("routine_qn")), "subscription_qn").select("object_qn", "subscription_qn", "routine_qn"),
)

# --- Q-13..Q-15: routines and modules ----------------------------------------------------------------------------------------

_ROUTINE = "SELECT qn, name, owner_qn FROM nodes WHERE label = 'Routine'"


def _routines(g: Graph, condition="true") -> DataFrame:
    return g.of("Routine").where(condition).select("qn", "name", "owner_qn")


_add("q13_name", f"{_ROUTINE} AND {_like('name', 'Routine_3', 'starts_with')}", lambda g: _routines(g, G.match("name", "Routine_3", "starts_with")))
_add("q13_signature", f"{_ROUTINE} AND contains(lower(name || '(' || coalesce(type_text, '') || ')'), 's1')", lambda g: _routines(g, G.match(F.concat("name", F.lit("("), F.coalesce("type_text", F.lit("")), F.lit(")")), "s1", "contains")))
_add("q13_exported", f"{_ROUTINE} AND note = 'N'", lambda g: _routines(g, "note = 'N'"))


def _unused(g: Graph) -> DataFrame:
    """Routines that nothing calls and that handle no event and no subscription."""
    out = _routines(g)
    for rel in ("CALLS", "HAS_EVENT_ACTION", "USES_HANDLER"):
        out = out.join(g.links(rel).select(F.col("dst").alias("qn")), "qn", "left_anti")
    return out


_add("q13_unused", f"{_ROUTINE} AND qn NOT IN (SELECT dst FROM edges WHERE rel IN ('CALLS', 'HAS_EVENT_ACTION', 'USES_HANDLER'))", _unused)
_add(
    "q14_routine_body",
    "SELECT qn, substring(qn, 6, 20) AS body_chunk, length(qn) AS body_length, length(qn) > 25 AS has_more FROM nodes WHERE label = 'Routine'",
    lambda g: g.of("Routine").select("qn", F.substring("qn", 6, 20).alias("body_chunk"), F.length("qn").cast("long").alias("body_length"), (F.length("qn") > 25).alias("has_more")),
)
_MODULES = "SELECT o.qn AS owner_qn, m.qn, m.name FROM edges e JOIN nodes o ON e.src = o.qn JOIN nodes m ON e.dst = m.qn WHERE e.rel = 'HAS_MODULE'"


def _modules(g: Graph) -> DataFrame:
    return G.expand(g.around("HAS_MODULE"), g.links("HAS_MODULE"), "HAS_MODULE")


_M = ("owner_qn", F.col)
_add("q15_modules_of_owner", f"{_MODULES} AND ends_with(o.qn, '2')", lambda g: _modules(g).where(F.col("owner_qn").endswith("2")).select("owner_qn", F.col("item_qn").alias("qn"), F.col("item_name").alias("name")))
_add(
    "q15_modules_by_owner_name",
    f"{_MODULES} AND {_like('o.name', '#00000001', 'contains')}",
    lambda g: _modules(g).where(G.match("owner_name", "#00000001", "contains")).select("owner_qn", F.col("item_qn").alias("qn"), F.col("item_name").alias("name")),
)
_add(
    "q15_module_routines",
    "SELECT e.src AS module_qn, r.qn, r.name FROM edges e JOIN nodes r ON e.dst = r.qn WHERE e.rel = 'DECLARES'",
    lambda g: g.links("DECLARES").join(g.targets("DECLARES").select("qn", "name"), F.col("dst") == F.col("qn")).select(F.col("src").alias("module_qn"), "qn", "name"),
)
_add(
    "q15_common_module_routines",
    "SELECT m.src AS owner_qn, d.dst AS qn FROM edges m JOIN edges d ON d.src = m.dst AND d.rel = 'DECLARES' JOIN nodes o ON m.src = o.qn WHERE m.rel = 'HAS_MODULE' AND o.category_name = 'NATION_5'",
    lambda g: g.links("HAS_MODULE").select(F.col("src").alias("owner_qn"), F.col("dst").alias("module"))
    .join(g.links("DECLARES").select(F.col("src").alias("module"), F.col("dst").alias("qn")), "module")
    .join(g.sources("HAS_MODULE").where("category_name = 'NATION_5'").select(F.col("qn").alias("owner_qn")), "owner_qn").select("owner_qn", "qn"),
)

# --- Q-16: call graph ------------------------------------------------------------------------------------------------------------

_add(
    "q16_callees",
    "SELECT c.src AS caller_qn, r.qn AS callee_qn, r.name AS callee_name, c.kind_text AS kind FROM edges c JOIN nodes r ON c.dst = r.qn WHERE c.rel = 'CALLS'",
    lambda g: g.links("CALLS").join(g.of("Routine").select("qn", "name"), F.col("dst") == F.col("qn"))
    .select(F.col("src").alias("caller_qn"), F.col("qn").alias("callee_qn"), F.col("name").alias("callee_name"), F.col("kind_text").alias("kind")),
)
_add(
    "q16_callers",
    "SELECT r.qn AS callee_qn, s.qn AS caller_qn, s.name AS caller_name FROM edges c JOIN nodes r ON c.dst = r.qn JOIN nodes s ON c.src = s.qn WHERE c.rel = 'CALLS' AND r.name = 'Routine_9'",
    lambda g: g.links("CALLS").join(g.of("Routine").where("name = 'Routine_9'").select(F.col("qn").alias("dst")), "dst")
    .join(g.of("Routine").select(F.col("qn").alias("src"), "name"), "src").select(F.col("dst").alias("callee_qn"), F.col("src").alias("caller_qn"), F.col("name").alias("caller_name")),
)
_add(
    "q16_between_owners",
    # One join after the other: the comparison of categories must not join all nodes with all nodes.
    """SELECT from_category, to_category, count(*) AS calls FROM (
        WITH x AS MATERIALIZED (SELECT a.category_name AS from_category, c.dst FROM edges c JOIN nodes a ON c.src = a.qn WHERE c.rel = 'CALLS'),
        y AS MATERIALIZED (SELECT x.from_category, b.category_name AS to_category FROM x JOIN nodes b ON x.dst = b.qn) SELECT * FROM y) z
    WHERE from_category <> to_category GROUP BY from_category, to_category""",
    lambda g: g.links("CALLS").join(g.of("Routine").select(F.col("qn").alias("src"), F.col("category_name").alias("from_category")), "src")
    .join(g.of("Routine").select(F.col("qn").alias("dst"), F.col("category_name").alias("to_category")), "dst").where("from_category <> to_category")
    .groupBy("from_category", "to_category").agg(F.count("*").alias("calls")),
)


def _trail_sql(depth: int, seeds: str) -> str:
    text = duck("SELECT 0")
    head = text[: text.rindex(" SELECT 0")].replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head}, calls AS MATERIALIZED (SELECT src, dst FROM edges WHERE rel = 'CALLS'), walk AS (
        SELECT src AS root, dst AS node, 1 AS hops, [src || chr(1) || dst] AS used FROM calls WHERE src IN (SELECT qn FROM nodes WHERE {seeds})
        UNION ALL SELECT w.root, c.dst, w.hops + 1, list_append(w.used, c.src || chr(1) || c.dst) FROM walk w JOIN calls c ON c.src = w.node
        WHERE w.hops < {depth} AND NOT list_contains(w.used, c.src || chr(1) || c.dst))"""


register("q16_subtree", _trail_sql(4, "name = 'Routine_5'") + " SELECT root, node, min(hops) AS depth, count(*) AS trails FROM walk GROUP BY root, node")(
    lambda spark, sf_dir: (
        lambda g: G.trails(g.links("CALLS"), "CALLS", g.of("Routine").where("name = 'Routine_5'"), 4)
        .groupBy("root", F.element_at("path", -1).alias("node"))
        .agg(F.min("hops").alias("depth"), F.count("*").alias("trails"))
    )(Graph(spark, sf_dir))
)

# --- Q-17: dependency paths ---------------------------------------------------------------------------------------------------------


def _family(name: str, rels: tuple[str, ...], reverse: bool, depth: int, seed: str) -> None:
    text = duck("SELECT 0")
    head = text[: text.rindex(" SELECT 0")].replace("WITH ", "WITH RECURSIVE ", 1)
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    quoted = "(" + ", ".join(f"'{r}'" for r in rels) + ")"
    sql = f"""{head}, steps AS MATERIALIZED (SELECT {src} AS a, rel, {dst} AS b FROM edges WHERE rel IN {quoted}), walk AS (
        SELECT a AS root, b AS node, 1 AS depth, [a, b] AS path, rel AS rels FROM steps WHERE a <> b AND a IN (SELECT qn FROM nodes WHERE {seed})
        UNION ALL SELECT w.root, s.b, w.depth + 1, list_append(w.path, s.b), w.rels || '>' || s.rel FROM walk w JOIN steps s ON s.a = w.node
        WHERE w.depth < {depth} AND NOT list_contains(w.path, s.b))
        SELECT root, array_to_string(path, '>') AS path_text, rels AS rel_text, depth FROM walk"""

    def build(spark, sf_dir) -> DataFrame:
        g = Graph(spark, sf_dir)
        steps = g.links(*rels).select(F.col(src).alias("src"), "rel", F.col(dst).alias("dst"))
        paths = G.simple_paths(steps, (g.targets if reverse else g.sources)(*rels).where(seed), depth)
        return paths.select("root", F.array_join("path", ">").alias("path_text"), F.array_join("rels", ">").alias("rel_text"), "depth")

    register(f"q17_{name}", sql)(build)


_family("used_in_downstream", ("USED_IN",), False, 2, "label = 'MetadataObject' AND num <= 5")
_family("used_in_upstream", ("USED_IN",), True, 2, "label = 'FormAttribute'")
_family("movements", ("DO_MOVEMENTS_IN", "USED_IN"), False, 2, "label = 'MetadataObject' AND num <= 40")
_family("movements_reverse", ("DO_MOVEMENTS_IN",), True, 2, "label = 'MetadataObject' AND num <= 3")
_family("calls", ("CALLS",), False, 3, "name = 'Routine_6'")
_family("calls_reverse", ("CALLS",), True, 3, "name = 'Routine_6'")
_family("binds_to", ("BINDS_TO",), False, 1, "label = 'FormControl'")
_family("links_to_command", ("LINKS_TO_COMMAND",), False, 1, "label = 'FormControl'")
_family("has_handler", ("HAS_HANDLER", "CALLS"), False, 2, "label = 'UrlMethod'")
_family("uses_handler", ("HAS_EVENT_SUBSCRIPTION", "USES_HANDLER"), False, 2, "label = 'MetadataObject' AND num <= 60")
_family("form_container", ("HAS_FORM", "HAS_CONTROL", "HAS_CHILD", "BINDS_TO"), False, 3, "label = 'MetadataObject' AND category_name = 'NATION_3'")


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Steps of each family and direction, as SQL over nodes and edges: src, rel, dst, free.
_FORM_CONTROL = "(SELECT form, control FROM form_control)"
_STEP_SQL = {
    ("USED_IN", "down"): f"SELECT e.src, e.rel, e.dst, false FROM edges e JOIN nodes a ON a.qn = e.src AND a.label = 'MetadataObject' WHERE e.rel = 'USED_IN' AND e.dst_label IN {_in(P.TYPED)}",
    ("USED_IN", "up"): f"""SELECT c.owner, 'USED_IN', e.src, false FROM edges e JOIN nodes a ON a.qn = e.src AND a.label = 'MetadataObject' JOIN (
        SELECT src AS owner, dst FROM edges WHERE rel IN {_in(P.TYPED_CHILDREN)} UNION ALL
        SELECT t.src, c.dst FROM edges c JOIN edges t ON t.dst = c.src AND t.rel = 'HAS_TABULAR_PART' WHERE c.rel IN {_in(P.TYPED_CHILDREN)}) c ON c.dst = e.dst JOIN nodes o ON o.qn = c.owner AND o.label = 'MetadataObject'
        WHERE e.rel = 'USED_IN' AND e.dst_label IN {_in(P.TYPED)}
        UNION ALL SELECT qn, 'OWNER_BRIDGE', array_to_string(string_split(qn, '/')[1:4], '/'), true FROM nodes WHERE label IN {_in(P.ELEMENTS)}""",
    ("DO_MOVEMENTS_IN", "down"): "SELECT src, rel, dst, false FROM edges WHERE rel = 'DO_MOVEMENTS_IN'",
    ("DO_MOVEMENTS_IN", "up"): f"""SELECT dst, rel, src, false FROM edges WHERE rel = 'DO_MOVEMENTS_IN'
        UNION ALL SELECT qn, 'OWNER_BRIDGE', array_to_string(string_split(qn, '/')[1:4], '/'), true FROM nodes WHERE label IN {_in(P.ELEMENTS)}""",
    ("CALLS", "down"): "SELECT src, rel, dst, false FROM edges WHERE rel = 'CALLS'",
    ("CALLS", "up"): "SELECT dst, rel, src, false FROM edges WHERE rel = 'CALLS'",
    ("CALLS", ""): "SELECT o.owner, 'OWNER_BRIDGE', o.routine, true FROM routine_owner o JOIN nodes n ON n.qn = o.owner AND n.label IN ('MetadataObject', 'Command', 'Form')",
    ("BINDS_TO", "down"): f"SELECT src, rel, dst, false FROM edges WHERE rel = 'BINDS_TO' UNION ALL SELECT f.form, e.rel, e.dst, false FROM edges e JOIN {_FORM_CONTROL} f ON f.control = e.src WHERE e.rel = 'BINDS_TO'",
    ("BINDS_TO", "up"): "SELECT dst, rel, src, false FROM edges WHERE rel = 'BINDS_TO'",
    ("LINKS_TO_COMMAND", "down"): f"SELECT src, rel, dst, false FROM edges WHERE rel = 'LINKS_TO_COMMAND' UNION ALL SELECT f.form, e.rel, e.dst, false FROM edges e JOIN {_FORM_CONTROL} f ON f.control = e.src WHERE e.rel = 'LINKS_TO_COMMAND'",
    ("LINKS_TO_COMMAND", "up"): "SELECT dst, rel, src, false FROM edges WHERE rel = 'LINKS_TO_COMMAND'",
    ("HAS_HANDLER", "down"): "SELECT src, rel, dst, false FROM edges WHERE rel = 'HAS_HANDLER'",
    ("HAS_HANDLER", "up"): "SELECT dst, rel, src, false FROM edges WHERE rel = 'HAS_HANDLER'",
    ("USES_HANDLER", "down"): "SELECT src, rel, dst, false FROM edges WHERE rel = 'USES_HANDLER'",
    ("USES_HANDLER", "up"): "SELECT dst, rel, src, false FROM edges WHERE rel = 'USES_HANDLER'",
}


def _walk_sql(rels: tuple[str, ...], direction: str, depth: int, seed: str, last: str = "") -> str:
    """Forked paths as one recursion: f = 0 is the node that a step reaches, f = 1 its owner."""
    text = duck("SELECT 0")
    head = text[: text.rindex(" SELECT 0")].replace("WITH ", "WITH RECURSIVE ", 1)
    ways = [w for w, skip in (("down", "upstream"), ("up", "downstream"), ("", "-")) if direction != skip]
    union = " UNION ALL ".join(_STEP_SQL[r, w] for r in rels for w in ways if (r, w) in _STEP_SQL)
    return f"""{head}, routine_owner AS MATERIALIZED (SELECT d.dst AS routine, coalesce(m.owner_qn, d.src) AS owner FROM edges d LEFT JOIN nodes m ON m.qn = d.src AND m.label = 'Module' WHERE d.rel = 'DECLARES'),
    form_control AS (SELECT e.src AS form, e.dst AS control FROM edges e JOIN nodes n ON n.qn = e.src AND n.label = 'Form' WHERE e.rel = 'HAS_CONTROL'
        UNION ALL SELECT f.form, c.dst FROM form_control f JOIN edges c ON c.src = f.control AND c.rel = 'HAS_CHILD'),
    step AS MATERIALIZED (SELECT s.src, s.rel, s.dst, s.free, n.label, CASE WHEN n.label = 'Routine' THEN o.owner WHEN n.label IN {_in(P.ELEMENTS)} THEN array_to_string(string_split(s.dst, '/')[1:4], '/') END AS owner
        FROM (SELECT DISTINCT * FROM ({union}) u(src, rel, dst, free)) s LEFT JOIN nodes n ON n.qn = s.dst LEFT JOIN routine_owner o ON o.routine = s.dst),
    walk AS (SELECT qn AS root, [qn] AS nodes, CAST([] AS VARCHAR[]) AS rels, CAST([] AS VARCHAR[]) AS chain, qn AS last, 0 AS depth, false AS is_path, true AS goes_on, 0 AS level FROM nodes WHERE {seed}
        UNION ALL SELECT root, CASE f WHEN 0 THEN to_nodes ELSE list_append(to_nodes, owner) END, CASE f WHEN 0 THEN to_rels ELSE list_append(to_rels, 'OWNER_BRIDGE') END, to_chain, CASE f WHEN 0 THEN dst ELSE owner END, to_depth, f = 0 AND NOT free,
            CASE WHEN f = 1 OR free THEN true ELSE label = 'Routine' OR NOT over END, level + 1
        FROM (SELECT *, NOT free AND coalesce(owner IS NOT NULL AND NOT list_contains(to_nodes, owner), false) AS over FROM (
            SELECT w.root, w.level, list_append(w.nodes, s.dst) AS to_nodes, list_append(w.rels, s.rel) AS to_rels, CASE WHEN s.free THEN w.chain ELSE list_append(w.chain, s.rel) END AS to_chain,
                w.depth + CASE WHEN s.free THEN 0 ELSE 1 END AS to_depth, s.dst, s.free, s.label, s.owner
            FROM walk w JOIN step s ON s.src = w.last WHERE w.goes_on AND w.depth < {depth} AND NOT list_contains(w.nodes, s.dst)) a) b, (VALUES (0), (1)) g(f)
        WHERE f = 0 OR (over AND to_depth < {depth}))
    SELECT root, array_to_string(nodes, '>') AS path_text, array_to_string(rels, '>') AS rel_text, array_to_string(chain, ',') AS chain_text, depth FROM walk WHERE is_path {last}"""


#: Further relations that the steps of a family are derived from.
_BESIDE = {
    "USED_IN": ("HAS_ATTRIBUTE", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_TABULAR_PART"), "DO_MOVEMENTS_IN": (), "CALLS": ("DECLARES",), "BINDS_TO": ("HAS_CONTROL", "HAS_CHILD"), "LINKS_TO_COMMAND": ("HAS_CONTROL", "HAS_CHILD"),
    "HAS_HANDLER": ("DECLARES", "HAS_EVENT_ACTION", "HAS_EVENT", "HAS_COMMAND", "HAS_CONTROL", "HAS_CHILD"), "USES_HANDLER": ("DECLARES", "HAS_EVENT_ACTION", "HAS_EVENT", "HAS_COMMAND", "HAS_CONTROL", "HAS_CHILD"),
}


def _reach(g: Graph, rels: tuple[str, ...], direction: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that ``hops`` reads for these families; every start of a path is among the nodes."""
    read = dict.fromkeys(x for r in rels for x in (r, *_BESIDE[r]))
    labels = [x for r in read for end in ENDS[r] for x in end]
    if direction != "downstream" and {"USED_IN", "DO_MOVEMENTS_IN"} & set(rels):
        labels += [x for x in P.ELEMENTS if x in KINDS or x == "FormAttribute"]
    if "CALLS" in rels:
        labels += ["MetadataObject", "Command", "Form"]
    return g.of(*dict.fromkeys(labels)), g.links(*read)


def _walk(name: str, rels: tuple[str, ...], direction: str, depth: int, seed: str, max_paths: int | None = None) -> None:
    last = "" if max_paths is None else f"ORDER BY level, root, nodes, rels LIMIT {max_paths}"

    def build(spark, sf_dir) -> DataFrame:
        g = Graph(spark, sf_dir)
        nodes, edges = _reach(g, rels, direction)
        paths = P.walk(P.hops(nodes, edges, rels, direction), nodes.where(seed), depth, max_paths)
        return paths.select("root", F.array_join("nodes", ">").alias("path_text"), F.array_join("rels", ">").alias("rel_text"), F.array_join("chain", ",").alias("chain_text"), "depth")

    register(f"q17_{name}", _walk_sql(rels, direction, depth, seed, last))(build)


_walk("calls_owner_bridge", ("CALLS",), "downstream", 2, "name = 'Routine_6'")
_walk("both_directions", ("USED_IN", "DO_MOVEMENTS_IN"), "both", 2, "label = 'MetadataObject' AND category_name <> 'Suppliers' AND num <= 3")
_walk("element_start", ("USED_IN",), "both", 1, "label = 'Attribute' AND num <= 40")
_walk("form_families", ("CALLS", "BINDS_TO", "LINKS_TO_COMMAND", "HAS_HANDLER", "USES_HANDLER"), "both", 2, "label = 'Form' AND num <= 400")
_walk("first_paths", ("CALLS", "USES_HANDLER"), "both", 4, "name = 'Routine_6'", 40)

# --- Q-22: object card and sections; Q-25..Q-29 console --------------------------------------------------------------------------------

_CARD = ("HAS_ATTRIBUTE", "HAS_TABULAR_PART", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_FORM", "HAS_COMMAND", "HAS_LAYOUT", "HAS_PREDEFINED", "HAS_GRAPH", "HAS_MODULE", "HAS_ENUM_VALUE", "HAS_URL_TEMPLATE", "HAS_EVENT_SUBSCRIPTION", "DO_MOVEMENTS_IN")
_add(
    "q22_overview",
    f"SELECT o.qn, {', '.join(f'count(CASE WHEN e.rel = {chr(39)}{r}{chr(39)} THEN 1 END) AS {r.lower()}' for r in _CARD)} FROM nodes o LEFT JOIN edges e ON e.src = o.qn WHERE o.label = 'MetadataObject' GROUP BY o.qn",
    lambda g: g.of("MetadataObject").select("qn").join(g.edges.select(F.col("src").alias("qn"), "rel"), "qn", "left")
    .groupBy("qn").agg(*[F.count(F.when(F.col("rel") == r, 1)).alias(r.lower()) for r in _CARD]),
)


def _limited(g: Graph) -> DataFrame:
    from pyspark.sql import Window as W

    rows = g.links("HAS_ATTRIBUTE", "HAS_FORM", "HAS_MODULE").select("src", "rel", "dst")
    place = F.row_number().over(W.partitionBy("src", "rel").orderBy("dst"))
    return rows.withColumn("place", place).where("place <= 2").select(F.col("src").alias("owner_qn"), "rel", F.col("dst").alias("qn"), "place")


_add(
    "q22_structure",
    "SELECT src AS owner_qn, rel, dst AS qn, place FROM (SELECT src, rel, dst, CAST(row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS INTEGER) AS place FROM edges WHERE rel IN ('HAS_ATTRIBUTE', 'HAS_FORM', 'HAS_MODULE')) x WHERE place <= 2",
    _limited,
)
_HOPS = {
    "forms": "HAS_FORM", "predefined": "HAS_PREDEFINED", "access": "GRANTS_ACCESS_TO", "subscriptions": "HAS_EVENT_SUBSCRIPTION", "usages": "USED_IN", "dependencies": "DO_MOVEMENTS_IN",
}
for _name, _rel in _HOPS.items():
    _key = "dst" if _name == "access" else "src"
    _add(
        f"q22_{_name}",
        f"SELECT {_key} AS object_qn, count(*) AS edges_n, count(DISTINCT {'src' if _key == 'dst' else 'dst'}) AS others, min({'src' if _key == 'dst' else 'dst'}) AS first_other FROM edges WHERE rel = '{_rel}' GROUP BY {_key}",
        lambda g, r=_rel, k=_key: (lambda o: g.links(r).groupBy(F.col(k).alias("object_qn")).agg(F.count("*").alias("edges_n"), F.countDistinct(o).alias("others"), F.min(o).alias("first_other")))("src" if k == "dst" else "dst"),
    )
for _name, _rel, _rel2 in (("form_events", "HAS_FORM", "HAS_EVENT"), ("form_attributes", "HAS_FORM", "HAS_FORM_ATTRIBUTE"), ("bsl", "HAS_MODULE", "DECLARES")):
    _add(
        f"q22_{_name}",
        f"SELECT a.src AS owner_qn, a.dst AS part_qn, c.qn, c.name, c.type_text FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes c ON b.dst = c.qn WHERE a.rel = '{_rel}' AND b.rel = '{_rel2}'",
        lambda g, r=_rel, r2=_rel2: _chain(g, r, r2),
    )
for _name, _rel, _key in (("uses", "USED_IN", "dst"), ("used_by", "USED_IN", "src"), ("movements", "DO_MOVEMENTS_IN", "src"), ("moved_by", "DO_MOVEMENTS_IN", "dst"), ("role_grants", "GRANTS_ACCESS_TO", "src"), ("access", "GRANTS_ACCESS_TO", "dst"), ("subscriptions", "HAS_EVENT_SUBSCRIPTION", "src"), ("extensions", "ADOPTED_FROM", "dst")):
    _other = "src" if _key == "dst" else "dst"
    _add(
        f"q27_{_name}",
        f"SELECT e.{_key} AS node_qn, n.label AS other_label, n.category_name AS other_category, count(*) AS links FROM edges e JOIN nodes n ON e.{_other} = n.qn WHERE e.rel = '{_rel}' GROUP BY e.{_key}, n.label, n.category_name",
        lambda g, r=_rel, k=_key, o=_other: g.links(r).join((g.sources if o == "src" else g.targets)(r).select(F.col("qn").alias(o), F.col("label").alias("other_label"), F.col("category_name").alias("other_category")), o)
        .groupBy(F.col(k).alias("node_qn"), "other_label", "other_category").agg(F.count("*").alias("links")),
    )
_add(
    "q25_tree",
    "SELECT config_name, category_name, count(*) AS objects, sum(count(*)) OVER (PARTITION BY config_name)::BIGINT AS config_objects FROM nodes WHERE label = 'MetadataObject' GROUP BY config_name, category_name",
    lambda g: (lambda per: per.join(per.groupBy("config_name").agg(F.sum("objects").alias("config_objects")), "config_name"))(
        g.of("MetadataObject").groupBy("config_name", "category_name").agg(F.count("*").alias("objects"))
    ),
)


def _console_search(g: Graph) -> DataFrame:
    """Best score of the branches for each node: prefix beats one edit."""
    n = F.lower("name")
    pool = g.of("MetadataObject", "MetadataCategory", "Resource").select("qn", "name", "label")
    a = pool.where(n.startswith("resource_1")).withColumn("score", F.lit(2))
    b = pool.where(F.levenshtein(n, F.lit("resource_14")) <= 1).withColumn("score", F.lit(1))
    return a.unionByName(b).groupBy("qn", "name", "label").agg(F.max("score").alias("score"))


_add(
    "q26_console_search",
    "SELECT qn, name, label, max(score) AS score FROM (SELECT qn, name, label, 2 AS score FROM nodes WHERE starts_with(lower(name), 'resource_1') AND label IN ('MetadataObject', 'MetadataCategory', 'Resource') UNION ALL SELECT qn, name, label, 1 FROM nodes WHERE levenshtein(lower(name), 'resource_14') <= 1 AND label IN ('MetadataObject', 'MetadataCategory', 'Resource')) x GROUP BY qn, name, label",
    _console_search,
)
_add_recursive(
    "q28_form_tree",
    "SELECT t.form AS form_qn, count(*) AS controls, max(t.depth) AS depth FROM tree t GROUP BY t.form",
    lambda g: _controls(g).groupBy(F.col("form").alias("form_qn")).agg(F.count("*").alias("controls"), F.max("depth").alias("depth")),
)
_add(
    "q29_statistics",
    "SELECT 'node' AS what, label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM (SELECT DISTINCT src, rel, dst FROM edges) e GROUP BY rel UNION ALL SELECT 'total', NULL, count(*) FROM nodes",
    lambda g: g.nodes.rollup("label").agg(F.count("*").alias("n"), F.grouping("label").alias("all"))
    .select(F.when(F.col("all") == 1, "total").otherwise("node").alias("what"), F.col("label").alias("kind"), "n")
    .unionByName(g.edges.select("src", "rel", "dst").distinct().groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.col("rel").alias("kind"), "n")),
)

# --- Q-23: extension against base ----------------------------------------------------------------------------------------------------------

_PAIRS = """(SELECT x.owner_qn AS ext_owner, x.qn AS ext_qn, b.qn AS base_qn, x.label, x.type_text AS ext_type, b.type_text AS base_type
    FROM rewritten x LEFT JOIN nodes b ON b.qn = x.rewritten)"""


def _overlay(g: Graph) -> DataFrame:
    """Extension children beside the base child that the rewritten path names."""
    ext = g.nodes.where("is_extension and type_text is not null").select(F.col("owner_qn").alias("ext_owner"), F.col("qn").alias("ext_qn"), "label", F.col("type_text").alias("ext_type"), F.replace("qn", F.lit("/EXT_"), F.lit("/")).alias("base_qn"))
    base = g.nodes.where("not is_extension").select(F.col("qn").alias("base_qn"), F.lit(True).alias("found"), F.col("type_text").alias("base_type"))
    state = F.when(F.col("found").isNull(), "extension_only").when(F.col("ext_type").eqNullSafe(F.col("base_type")), "adopted").otherwise("modified")
    return ext.join(base, "base_qn", "left").withColumn("state", state)


_STATE = "CASE WHEN base_qn IS NULL THEN 'extension_only' WHEN ext_type IS NOT DISTINCT FROM base_type THEN 'adopted' ELSE 'modified' END"
_add("q23_structure", f"SELECT ext_qn, label, {_STATE} AS state FROM {_PAIRS} p", lambda g: _overlay(g).select("ext_qn", "label", "state"))
_add("q23_forms", f"SELECT ext_qn, {_STATE} AS state FROM {_PAIRS} p WHERE label = 'Form'", lambda g: _overlay(g).where("label = 'Form'").select("ext_qn", "state"))
_add("q23_bsl", f"SELECT ext_qn, base_qn, {_STATE} AS state FROM {_PAIRS} p WHERE label = 'Module'", lambda g: _overlay(g).where("label = 'Module'").select("ext_qn", F.when(F.col("found"), F.col("base_qn")).alias("base_qn"), "state"))
_add("q23_form_items", f"SELECT ext_owner, label, count(*) AS items, count(CASE WHEN {_STATE} = 'modified' THEN 1 END) AS modified FROM {_PAIRS} p GROUP BY ext_owner, label", lambda g: _overlay(g).groupBy("ext_owner", "label").agg(F.count("*").alias("items"), F.count(F.when(F.col("state") == "modified", 1)).alias("modified")))
_add(
    "q23_counts",
    f"""SELECT label, {_STATE} AS state, count(*) AS n FROM {_PAIRS} p GROUP BY label, {_STATE} UNION ALL SELECT b.label, 'base_only', count(*) FROM nodes b JOIN edges a ON a.dst = b.owner_qn AND a.rel = 'ADOPTED_FROM' WHERE NOT b.is_extension AND b.type_text IS NOT NULL AND b.qn NOT IN (SELECT dst FROM edges WHERE rel = 'ADOPTED_FROM') AND b.label IN (SELECT DISTINCT label FROM nodes WHERE is_extension AND type_text IS NOT NULL) GROUP BY b.label""",
    lambda g: _overlay(g).groupBy("label", "state").agg(F.count("*").alias("n")).unionByName(
        g.nodes.where("not is_extension and type_text is not null")
        .join(g.links("ADOPTED_FROM").select(F.col("dst").alias("owner_qn")), "owner_qn")
        .join(g.links("ADOPTED_FROM").select(F.col("dst").alias("qn")), "qn", "left_anti")
        .join(g.nodes.where("is_extension and type_text is not null").select("label").distinct(), "label", "left_semi")
        .groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit("base_only").alias("state"), "n")
    ),
)
