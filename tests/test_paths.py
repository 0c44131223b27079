"""Forked paths against plain Python on random graphs, and steps on a graph written by hand."""

import random
from collections import deque

import pytest

from lodestone.operators import paths

NODES = "qn string, label string, name string, config_name string, category_name string, owner_qn string"
EDGES = "src string, rel string, dst string, dst_label string"


def brute(steps, seeds, max_depth):
    """Every path by one queue of partial paths."""
    after = {}
    for s in steps:
        after.setdefault(s["src"], []).append(s)
    out = set()
    for root in seeds:
        queue = deque([((root,), (), 0, 0)])
        while queue:
            nodes, rels, depth, level = queue.popleft()
            if depth == max_depth:
                continue
            for s in after.get(nodes[-1], []):
                to = s["dst"]
                if to in nodes:
                    continue
                went = (nodes + (to,), rels + (s["rel"],))
                if s["free"]:
                    queue.append((*went, depth, level + 1))
                    continue
                out.add((root, *went, depth + 1, level + 1))
                owner = "/".join(to.split("/")[:4]) if s["dst_label"] in paths.ELEMENTS else s["dst_owner"] if s["dst_label"] == "Routine" else None
                fork = owner is not None and owner not in went[0]
                if fork:
                    queue.append((went[0] + (owner,), went[1] + ("OWNER_BRIDGE",), depth + 1, level + 1))
                if s["dst_label"] == "Routine" or not fork:
                    queue.append((*went, depth + 1, level + 1))
    return out


def walked(df):
    return sorted((r["root"], tuple(r["nodes"]), tuple(r["rels"]), r["depth"]) for r in df.collect())


def random_steps(rng):
    objects = [f"p/c/k/O{k}" for k in range(4)]
    elements = [f"{o}/Attribute/a{k}" for o in objects for k in range(2)]
    routines = [(f"r{k}", rng.choice([*objects, None])) for k in range(6)]
    label = {o: "MetadataObject" for o in objects} | {e: "Attribute" for e in elements} | {r: "Routine" for r, _ in routines}
    owner = dict(routines)
    every, out = list(label), set()
    for _ in range(22):
        a, b = rng.choice(every), rng.choice(every)
        out.add((a, rng.choice(["CALLS", "USED_IN"]), b, False))
    out |= {(e, "OWNER_BRIDGE", "/".join(e.split("/")[:4]), True) for e in elements if rng.random() < 0.5}
    out |= {(o, "OWNER_BRIDGE", r, True) for r, o in routines if o and rng.random() < 0.7}
    return [dict(zip(paths.STEP, (a, rel, b, label[b], b, owner.get(b), free))) for a, rel, b, free in sorted(out)]


@pytest.mark.parametrize("seed", range(6))
def test_paths_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    steps = random_steps(rng)
    table = spark.createDataFrame([tuple(s.values()) for s in steps], "src string, rel string, dst string, dst_label string, dst_name string, dst_owner string, free boolean")
    seeds = sorted({s["src"] for s in steps})[:3]
    start = spark.createDataFrame([(x,) for x in seeds], "qn string")
    want = brute(steps, seeds, 3)
    got = walked(paths.walk(table, start, 3))
    assert got == sorted(p[:4] for p in want)
    # An early stop returns the first paths by level, then by nodes and relations.
    few = paths.walk(table, start, 3, max_paths=5).collect()
    assert [(r["root"], tuple(r["nodes"]), tuple(r["rels"]), r["depth"]) for r in few] == [p[:4] for p in sorted(want, key=lambda p: (p[4], *p[:3]))[:5]]


def graph(spark):
    obj = "p/c/Cat/Doc"
    nodes = [(obj, "MetadataObject", "Doc", "c", "Cat", "p/c/Cat"), ("p/c/Cat/Ref", "MetadataObject", "Ref", "c", "Cat", "p/c/Cat"), ("p/d/Cat/Far", "MetadataObject", "Far", "d", "Cat", "p/d/Cat")]
    nodes += [(f"{obj}/Attribute/A", "Attribute", "A", "c", "Cat", obj), (f"{obj}/TabularPart/T", "TabularPart", "T", "c", "Cat", obj), (f"{obj}/TabularPart/T/Attribute/B", "Attribute", "B", "c", "Cat", f"{obj}/TabularPart/T")]
    nodes += [(f"{obj}/Module/M", "Module", "M", "c", "Cat", obj), ("r1", "Routine", "r1", "c", "Cat", f"{obj}/Module/M"), ("r2", "Routine", "r2", "c", "Cat", f"{obj}/Module/M"), ("r3", "Routine", "r3", "d", "Cat", "p/d/Cat/Far")]
    form = f"{obj}/Form/F"
    nodes += [(form, "Form", "F", "c", "Cat", obj), (f"{form}/C1", "FormControl", "C1", "c", "Cat", form), (f"{form}/C2", "FormControl", "C2", "c", "Cat", form), (f"{form}/X", "FormAttribute", "X", "c", "Cat", form)]
    nodes += [(f"{form}/K", "Command", "K", "c", "Cat", form), (f"{form}/E", "FormEvent", "E", "c", "Cat", form), (f"{form}/E/Action", "FormEventAction", "Action", "c", "Cat", form), (f"{form}/CE", "FormEvent", "CE", "c", "Cat", form), (f"{form}/CE/Action", "FormEventAction", "Action", "c", "Cat", form)]
    label = {n[0]: n[1] for n in nodes}
    edges = [("p/c/Cat/Ref", "USED_IN", f"{obj}/Attribute/A"), ("p/d/Cat/Far", "USED_IN", f"{obj}/TabularPart/T/Attribute/B"), (obj, "HAS_ATTRIBUTE", f"{obj}/Attribute/A"), (obj, "HAS_TABULAR_PART", f"{obj}/TabularPart/T"), (f"{obj}/TabularPart/T", "HAS_ATTRIBUTE", f"{obj}/TabularPart/T/Attribute/B")]
    edges += [(obj, "DO_MOVEMENTS_IN", "p/c/Cat/Ref"), (obj, "HAS_MODULE", f"{obj}/Module/M"), (f"{obj}/Module/M", "DECLARES", "r1"), (f"{obj}/Module/M", "DECLARES", "r2"), ("p/d/Cat/Far", "DECLARES", "r3"), ("r1", "CALLS", "r2"), ("r2", "CALLS", "r3"), ("r1", "CALLS", "r1")]
    edges += [(form, "HAS_CONTROL", f"{form}/C1"), (f"{form}/C1", "HAS_CHILD", f"{form}/C2"), (f"{form}/C2", "BINDS_TO", f"{form}/X"), (f"{form}/C1", "LINKS_TO_COMMAND", f"{form}/K"), (form, "HAS_COMMAND", f"{form}/K"), (f"{form}/K", "HAS_HANDLER", "r1")]
    edges += [(form, "HAS_EVENT", f"{form}/E"), (f"{form}/E", "HAS_EVENT_ACTION", f"{form}/E/Action"), (f"{form}/E/Action", "HAS_HANDLER", "r2"), (f"{form}/C2", "HAS_EVENT", f"{form}/CE"), (f"{form}/CE", "HAS_EVENT_ACTION", f"{form}/CE/Action"), (f"{form}/CE/Action", "USES_HANDLER", "r1")]
    table = spark.createDataFrame([(a, rel, b, label[b]) for a, rel, b in edges], EDGES)
    return spark.createDataFrame(nodes, NODES), table, obj, form


def steps_of(df):
    return {(r["src"], r["rel"], r["dst"], r["free"]) for r in df.collect()}


def test_steps_of_every_family(spark):
    nodes, edges, obj, form = graph(spark)
    a, b = f"{obj}/Attribute/A", f"{obj}/TabularPart/T/Attribute/B"
    ref, far, bridge = "p/c/Cat/Ref", "p/d/Cat/Far", "OWNER_BRIDGE"
    free = {(x, bridge, obj, True) for x in (a, b, f"{obj}/TabularPart/T", f"{form}/X")}
    assert steps_of(paths.hops(nodes, edges, ("USED_IN",), "downstream")) == {(ref, "USED_IN", a, False), (far, "USED_IN", b, False)}
    assert steps_of(paths.hops(nodes, edges, ("USED_IN",), "upstream")) == {(obj, "USED_IN", ref, False), (obj, "USED_IN", far, False)} | free
    assert steps_of(paths.hops(nodes, edges, ("USED_IN",), "upstream", config="c")) == {(obj, "USED_IN", ref, False)} | free
    moves = {(obj, "DO_MOVEMENTS_IN", ref, False)}
    assert steps_of(paths.hops(nodes, edges, ("DO_MOVEMENTS_IN",), "both")) == moves | {(ref, "DO_MOVEMENTS_IN", obj, False)} | free
    declared = {(obj, bridge, "r1", True), (obj, bridge, "r2", True), (far, bridge, "r3", True)}
    assert steps_of(paths.hops(nodes, edges, ("CALLS",))) == {("r1", "CALLS", "r2", False), ("r2", "CALLS", "r3", False), ("r1", "CALLS", "r1", False)} | declared
    assert steps_of(paths.hops(nodes, edges, ("BINDS_TO",))) == {(f"{form}/C2", "BINDS_TO", f"{form}/X", False), (form, "BINDS_TO", f"{form}/X", False)}
    assert steps_of(paths.hops(nodes, edges, ("LINKS_TO_COMMAND",), "upstream")) == {(f"{form}/K", "LINKS_TO_COMMAND", f"{form}/C1", False)}
    handled = {(f"{form}/K", "r1"), (form, "r1"), (f"{form}/E/Action", "r2"), (f"{form}/E", "r2"), (form, "r2")}
    assert steps_of(paths.hops(nodes, edges, ("HAS_HANDLER",))) == {(x, "HAS_HANDLER", r, False) for x, r in handled}
    assert steps_of(paths.hops(nodes, edges, ("USES_HANDLER",))) == {(x, "USES_HANDLER", "r1", False) for x in (f"{form}/CE/Action", f"{form}/CE", form)}


def test_a_reached_routine_stays_beside_its_owner(spark):
    nodes, edges, obj, _ = graph(spark)
    seeds = nodes.where("qn = 'r1'").select("qn")
    got = walked(paths.walk(paths.hops(nodes, edges, ("CALLS",)), seeds, 2))
    assert ("r1", ("r1", "r2", "r3"), ("CALLS", "CALLS"), 2) in got and len(got) == 2
    both = walked(paths.walk(paths.hops(nodes, edges, ("CALLS", "DO_MOVEMENTS_IN")), seeds, 2))
    assert ("r1", ("r1", "r2", obj, "p/c/Cat/Ref"), ("CALLS", "OWNER_BRIDGE", "DO_MOVEMENTS_IN"), 2) in both


def test_free_steps_may_start_a_path_and_end_none(spark):
    nodes, edges, obj, _ = graph(spark)
    seeds = nodes.where("name = 'A'").select("qn")
    got = walked(paths.walk(paths.hops(nodes, edges, ("USED_IN",), "both"), seeds, 1))
    root = f"{obj}/Attribute/A"
    assert got == [(root, (root, obj, "p/c/Cat/Ref"), ("OWNER_BRIDGE", "USED_IN"), 1), (root, (root, obj, "p/d/Cat/Far"), ("OWNER_BRIDGE", "USED_IN"), 1)]


def test_unknown_direction_or_family(spark):
    nodes, edges, _, _ = graph(spark)
    with pytest.raises(ValueError):
        paths.hops(nodes, edges, ("CALLS",), "sideways")
    with pytest.raises(ValueError):
        paths.hops(nodes, edges, ("EATS",))
