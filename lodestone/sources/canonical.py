"""Hash trees of markup: what an extension's form changed of the controls that it took from its base.

An element's hash is made of its name, its attributes by name without ``id``, its text
without blanks around it, and the hashes of its children in order, so it is made once from the
leaves up, and equal subtrees have equal hashes wherever they stand and however
they are written. A form has its controls and, below ``BaseForm``, those that it was made from; a control is matched
by its number.

Defined cases: a null or broken text has no controls; a control without a whole number is the
form's own; of base controls with one number the last counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of a form.
CHILDREN, BASE = "ChildItems", "BaseForm"

CONTROLS = "base boolean, place int, id long, name string, kind string, hash string, parts map<string,string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def digest(*parts: str) -> str:
    """Hash of texts in order; each with its length, so that no two lists read alike."""
    h = hashlib.sha256()
    for p in parts:
        data = p.encode()
        h.update(len(data).to_bytes(8, "little") + data)
    return h.hexdigest()


def hashes(root: ElementTree.Element) -> dict[ElementTree.Element, str]:
    """Hash of every element below ``root`` and of itself, leaves first."""
    out: dict[ElementTree.Element, str] = {}
    order = list(root.iter())
    for e in reversed(order):  # children stand behind their parent
        attributes = [x for k in sorted(e.attrib) if k != "id" for x in (k, e.attrib[k])]
        below = [x for c in e for x in (out[c], (c.tail or "").strip())]
        out[e] = digest(e.tag, *attributes, "\x00", (e.text or "").strip(), *below)
    return out


def _controls(text: str) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return
    of = hashes(root)
    base = {x for b in root if _local(b.tag) == BASE for x in b.iter()}
    for place, e in enumerate(c for items in root.iter() if _local(items.tag) == CHILDREN for c in items):
        parts = {"@kind": _local(e.tag), "@name": e.get("name") or ""}
        for c in e:
            name = _local(c.tag)
            parts[name] = digest(*(of[x] for x in c)) if name == CHILDREN else of[c]
        number = (e.get("id") or "").strip()
        yield e in base, place, int(number) if number.lstrip("-").isdigit() else None, e.get("name"), _local(e.tag), of[e], parts


def controls(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every control of every form, with its hash and those of its properties."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text]) if t for r in _controls(t)]
            out = pd.DataFrame(rows, columns=[key, "base", "place", "id", "name", "kind", "hash", "parts"])
            out["id"] = out["id"].astype("Int64")
            yield out

    return df.select(key, text).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, {CONTROLS}")


def states(found: DataFrame, key: str) -> DataFrame:
    """The form's own side of ``controls``: own, adopted_unchanged or adopted_modified, and the properties that differ."""
    last = found.where("base and id is not null").groupBy(key, "id").agg(F.max_by(F.struct("hash", "parts"), "place").alias("was"))
    rows = found.where("not base").join(last, [key, "id"], "left")
    was = F.col("was")
    state = F.when(was.isNull(), "own").when(was["hash"] == F.col("hash"), "adopted_unchanged").otherwise("adopted_modified")
    return rows.select(key, "place", "id", "name", "kind", state.alias("state"), F.when(state == "adopted_modified", differing(F.col("parts"), was["parts"])).alias("modified"))


def differing(a: Column, b: Column) -> Column:
    """Sorted keys that two maps do not share with equal values."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~a[k].eqNullSafe(b[k])))
