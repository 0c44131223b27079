"""Dependency paths: counted hops along families of relations, and free steps to owners and back.

``hops`` turns a graph into one table of steps, a row for each way to go on from
a node; ``walk`` joins a frontier of paths with it, level by level. A step is
*free* if it leads from an element to its object or from an owner to a routine
that it declares: it costs no depth and ends no path. After a counted hop the
frontier goes on

* from a routine and, as a second path, from the routine's owner;
* from an element's object in place of the element, unless the path has been there
  or the hop came from it;
* else from the node that was reached.

No node is on a path twice. Each level is written once and read by the next, so a
lost executor costs a part of one level. Steps are distinct by (from, to, relation),
hence paths are: two of them differ in a step.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

# Labels and relations of the graph.
ELEMENTS = ("Attribute", "Resource", "Dimension", "AccountingFlag", "DimensionAccountingFlag", "FormAttribute", "TabularPart")
TYPED = ("Attribute", "Resource", "Dimension", "AccountingFlag", "DimensionAccountingFlag", "FormAttribute")
TYPED_CHILDREN = ("HAS_ATTRIBUTE", "HAS_RESOURCE", "HAS_DIMENSION", "HAS_ACCOUNTING_FLAG", "HAS_DIMENSION_ACCOUNTING_FLAG")
BOUND = ("Attribute", "Dimension", "Resource", "FormAttribute", "MetadataObject")
HANDLED = ("UrlMethod", "FormEventAction", "Command")
COMMON_FORMS = "ОбщиеФормы"
BRIDGE = "OWNER_BRIDGE"
FAMILIES = ("USED_IN", "DO_MOVEMENTS_IN", "CALLS", "BINDS_TO", "LINKS_TO_COMMAND", "HAS_HANDLER", "USES_HANDLER")

STEP = ("src", "rel", "dst", "dst_label", "dst_name", "dst_owner", "free")


def object_of(qn: Column) -> Column:
    """Path of the object that an element's path lies below: its first four parts."""
    return F.substring_index(qn, "/", 4)


def _routine_owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(routine, owner): the owner of the module that declares it, or the node that declares it itself."""
    modules = nodes.where("label = 'Module'").select(F.col("qn").alias("src"), F.col("owner_qn").alias("module_owner"))
    declared = edges.where("rel = 'DECLARES'").select("src", F.col("dst").alias("routine"))
    return declared.join(modules, "src", "left").select("routine", F.coalesce("module_owner", "src").alias("owner"))


def _form_controls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(form, control) for all controls of a form, at any depth."""
    control = edges.where("rel = 'HAS_CONTROL'").select(F.col("src").alias("form"), F.col("dst").alias("control"))
    child = edges.where("rel = 'HAS_CHILD'").select(F.col("src").alias("control"), F.col("dst").alias("next"))
    forms = nodes.where((F.col("label") == "Form") | ((F.col("label") == "MetadataObject") & (F.col("category_name") == COMMON_FORMS)))
    level = materialise(control.join(forms.select(F.col("qn").alias("form")), "form"), "controls")
    child, out = materialise(child, "children"), level
    while not level.isEmpty():
        level = materialise(level.join(child, "control").select("form", F.col("next").alias("control")), "controls")
        out = out.unionByName(level)
    return out


def hops(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...], direction: str = "downstream", config: str | None = None) -> DataFrame:
    """All steps along ``rels`` (of ``FAMILIES``) downstream, upstream or both: src, rel, dst, its label, name and owner, free.

    ``config`` keeps steps to nodes of one configuration, but for controls' targets, which belong to the form's.
    """
    if direction not in ("downstream", "upstream", "both") or not set(rels) <= set(FAMILIES):
        raise ValueError(f"unknown direction {direction} or relation in {rels}")
    down, up = direction != "upstream", direction != "downstream"
    ends = nodes.select("qn", "label", "name", "config_name")
    src = ends.select(F.col("qn").alias("src"), F.col("label").alias("src_label"))
    typed = edges.where(F.col("rel").isin(list(rels))).select("src", "rel", "dst", F.col("dst_label").alias("to_label")).join(src, "src")
    typed = materialise(typed, "typed-edges")
    label, to_label = F.col("src_label"), F.col("to_label")
    plain = lambda rows, rel: rows.select("src", F.lit(rel).alias("rel"), "dst", F.lit(False).alias("free"))
    back = lambda rows, rel: rows.select(F.col("dst").alias("src"), F.lit(rel).alias("rel"), F.col("src").alias("dst"), F.lit(False).alias("free"))
    within: list[DataFrame] = []
    anywhere: list[DataFrame] = []

    def of(rel: str) -> DataFrame:
        return typed.where(F.col("rel") == rel)

    def of_forms(rows: DataFrame) -> DataFrame:
        """Steps of a form's controls as steps of the form."""
        return rows.join(_form_controls(nodes, edges).select(F.col("control").alias("src"), "form"), "src").select(F.col("form").alias("src"), "dst")

    if "USED_IN" in rels:
        uses = of("USED_IN").where((label == "MetadataObject") & to_label.isin(list(TYPED)))
        if down:
            within.append(plain(uses, "USED_IN"))
        if up:
            objects = nodes.where("label = 'MetadataObject'").select(F.col("qn").alias("owner"))
            child = edges.where(F.col("rel").isin(list(TYPED_CHILDREN))).select(F.col("src").alias("owner"), "dst")
            tables = edges.where("rel = 'HAS_TABULAR_PART'").select(F.col("src").alias("object"), F.col("dst").alias("owner"))
            deep = child.join(tables, "owner").select(F.col("object").alias("owner"), "dst")
            used = uses.select(F.col("src").alias("type_object"), "dst").join(child.unionByName(deep).join(objects, "owner"), "dst")
            within.append(used.select(F.col("owner").alias("src"), F.lit("USED_IN").alias("rel"), F.col("type_object").alias("dst"), F.lit(False).alias("free")))
    if "DO_MOVEMENTS_IN" in rels:
        moves = of("DO_MOVEMENTS_IN").where((label == "MetadataObject") & (to_label == "MetadataObject"))
        within += [plain(moves, "DO_MOVEMENTS_IN")] * down + [back(moves, "DO_MOVEMENTS_IN")] * up
    if up and {"USED_IN", "DO_MOVEMENTS_IN"} & set(rels):
        elements = nodes.where(F.col("label").isin(list(ELEMENTS)))
        anywhere.append(elements.select(F.col("qn").alias("src"), F.lit(BRIDGE).alias("rel"), object_of(F.col("qn")).alias("dst"), F.lit(True).alias("free")))
    owners = materialise(_routine_owners(nodes, edges), "routine-owners")
    if "CALLS" in rels:
        calls = of("CALLS").where((label == "Routine") & (to_label == "Routine"))
        within += [plain(calls, "CALLS")] * down + [back(calls, "CALLS")] * up
        holders = nodes.where(F.col("label").isin("MetadataObject", "Command", "Form")).select(F.col("qn").alias("owner"))
        within.append(owners.join(holders, "owner").select(F.col("owner").alias("src"), F.lit(BRIDGE).alias("rel"), F.col("routine").alias("dst"), F.lit(True).alias("free")))
    for rel, allowed in (("BINDS_TO", BOUND), ("LINKS_TO_COMMAND", ("Command",))):
        if rel in rels:
            bound = of(rel).where((label == "FormControl") & to_label.isin(list(allowed)))
            if down:
                anywhere += [plain(bound, rel), plain(of_forms(bound), rel)]
            if up:
                within.append(back(of(rel).where(label == "FormControl") if rel == "BINDS_TO" else bound, rel))
    action = edges.where("rel = 'HAS_EVENT_ACTION'").select(F.col("src").alias("event"), F.col("dst").alias("src"))
    for rel in {"HAS_HANDLER", "USES_HANDLER"} & set(rels):
        handled = of(rel).where(to_label == "Routine")
        if down:
            # Events and forms stand for their actions and commands.
            by_event = handled.join(action, "src").select(F.col("event").alias("src"), "dst")
            of_form = edges.where("rel in ('HAS_EVENT', 'HAS_COMMAND')").select(F.col("src").alias("form"), F.col("dst").alias("src"))
            forms = nodes.where((F.col("label") == "Form") | (F.col("category_name") == COMMON_FORMS)).select(F.col("qn").alias("form"))
            direct = handled.where(label.isin(list(HANDLED)) if rel == "HAS_HANDLER" else ~label.isin("Form", "FormEvent"))
            commands = handled.where(label == "Command").select("src", "dst")
            flat = by_event.unionByName(commands).join(of_form.join(forms, "form"), "src").select(F.col("form").alias("src"), "dst")
            events = edges.where("rel = 'HAS_EVENT'").select("src", F.col("dst").alias("event"))
            by_control = by_event.select(F.col("src").alias("event"), "dst").join(events, "event").select("src", "dst")
            within += [plain(x, rel) for x in (direct, by_event, flat, of_forms(by_control))]
        if up:
            within.append(back(handled.where(label.isin(list(HANDLED))) if rel == "HAS_HANDLER" else handled, rel))
    to = ends.select(F.col("qn").alias("dst"), F.col("label").alias("dst_label"), F.col("name").alias("dst_name"), F.col("config_name").alias("_config"))
    parts = [x for x in (_union(within), _union(anywhere)) if x is not None]
    if config is not None:
        inside = to.where(F.col("_config") == config).select("dst")
        parts = [x.join(inside, "dst", "left_semi").select("src", "rel", "dst", "free") if k == 0 and within else x for k, x in enumerate(parts)]
    steps = _union(parts).distinct().join(to.drop("_config"), "dst", "left")
    return steps.join(owners.select(F.col("routine").alias("dst"), F.col("owner").alias("dst_owner")), "dst", "left").select(*STEP)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def walk(steps: DataFrame, seeds: DataFrame, max_depth: int, max_paths: int | None = None) -> DataFrame:
    """Paths of at most ``max_depth`` counted hops from each seed (qn): root, nodes, rels (of all steps), chain (of counted ones), end, its label and owner, depth, level.

    A level is one step of all open paths; the owner after a counted hop is part of that step. With ``max_paths`` the walk ends
    at the level in which that many are found, and returns that many: by level, then by root, nodes and relations.
    """
    step = materialise(steps.select(*(F.col(c).alias(f"s_{c}") for c in STEP)), "steps")
    level = materialise(seeds.select(F.col("qn").alias("root"), F.array("qn").alias("nodes"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<string>").alias("chain"), F.col("qn").alias("last"), F.lit(0).alias("depth")), "frontier")
    done: list[DataFrame] = []
    n = 0
    for at in count(1):
        met = level.where(F.col("depth") < max_depth).join(step, F.col("last") == F.col("s_src")).where(~F.array_contains("nodes", F.col("s_dst")))
        free = F.col("s_free")
        met = met.select(
            "root",
            F.concat("nodes", F.array("s_dst")).alias("nodes"),
            F.concat("rels", F.array("s_rel")).alias("rels"),
            F.when(free, F.col("chain")).otherwise(F.concat("chain", F.array("s_rel"))).alias("chain"),
            F.col("s_dst").alias("last"),
            (F.col("depth") + F.when(free, 0).otherwise(1)).alias("depth"),
            free.alias("free"),
            F.col("s_dst_label").alias("label"),
            F.col("s_dst_name").alias("name"),
            F.when(F.col("s_dst_label").isin(list(ELEMENTS)), object_of(F.col("s_dst"))).when(F.col("s_dst_label") == "Routine", F.col("s_dst_owner")).alias("owner"),
            F.col("last").alias("came_from"),
            F.lit(at).alias("level"),
        )
        met = materialise(met, "level")
        found = met.where(~F.col("free"))
        done.append(found)
        if max_paths is not None:
            n += found.count()
            if n >= max_paths:
                break
        if met.isEmpty():
            break
        level = _frontier(met)
    out = _union(done).select("root", "nodes", "rels", "chain", F.col("last").alias("end"), F.col("label").alias("end_label"), F.col("name").alias("end_name"), F.col("owner").alias("end_owner"), "depth", "level")
    if max_paths is not None:
        out = out.orderBy("level", "root", "nodes", "rels").limit(max_paths)
    return out


def _frontier(met: DataFrame) -> DataFrame:
    """Where the next level goes on from the steps of this one."""
    can = F.col("owner").isNotNull() & ~F.array_contains("nodes", F.col("owner"))
    bridge = ~F.col("free") & can & ((F.col("label") == "Routine") | (F.col("owner") != F.col("came_from")))
    stay = F.col("free") | (F.col("label") == "Routine") | ~F.coalesce(bridge, F.lit(False))
    kept = ("root", "chain", "depth")
    here = met.where(stay).select(*kept, "nodes", "rels", "last")
    over = met.where(bridge).select(*kept, F.concat("nodes", F.array("owner")).alias("nodes"), F.concat("rels", F.array(F.lit(BRIDGE))).alias("rels"), F.col("owner").alias("last"))
    return here.unionByName(over)
