"""Parsers of configuration files: each takes a key and the file's XML and gives rows.

Files are parsed where they are read, an Arrow batch at a time. A file that is
null or no well-formed XML gives no rows. Namespaces are ignored.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if _tag(c) == name]


def _one(node: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        node = next(iter(_all(node, name)), None)
    return node


def _text(node: ET.Element | None, *names: str) -> str | None:
    found = _one(node, *names)
    return (found.text or "").strip() or None if found is not None else None


def parsed(df: DataFrame, key: str, xml: str, rows: Callable[[ET.Element], Iterator[tuple]], columns: str) -> DataFrame:
    """``rows`` of every file, each after the file's key."""
    names = [key, *(c.split()[0] for c in columns.split(", "))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[xml]):
                try:
                    root = ET.fromstring(text) if text else None
                except ET.ParseError:
                    root = None
                if root is not None:
                    out += [(k, *r) for r in rows(root)]
            yield pd.DataFrame(out, columns=names)

    return df.select(key, xml).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, {columns}")


# --- metadata objects ---------------------------------------------------------------------------------------


def _type_list(node: ET.Element | None) -> str | None:
    """Types of an element, without name space marks; lengths and digits in brackets."""
    if node is None:
        return None
    length, digits, fraction = (next((d.text for d in node.iter() if _tag(d) == n), None) for n in ("Length", "Digits", "FractionDigits"))
    out = []
    for t in node.iter():
        if _tag(t) != "Type" or t is node or not t.text:
            continue
        name = t.text.strip().rpartition(":")[2]
        if name == "string":
            name = f"String({length})" if length and length != "0" else "String"
        elif name == "decimal":
            name = f"Number({digits},{fraction or 0})" if digits else "Number"
        elif name in ("boolean", "dateTime"):
            name = {"boolean": "Boolean", "dateTime": "Date"}[name]
        out.append(name)
    return ",".join(out) or None


def _synonym(properties: ET.Element | None) -> str | None:
    items = _all(_one(properties, "Synonym"), "item")
    return next((_text(i, "content") for i in items if _text(i, "content")), None)


def _object_rows(root: ET.Element) -> Iterator[tuple]:
    first = next(iter(root), None) if _tag(root) == "MetaDataObject" else root
    if first is None:
        return
    todo: list[tuple[ET.Element, str | None]] = [(first, None)]
    while todo:
        node, owner = todo.pop(0)
        properties = _one(node, "Properties")
        if properties is None:
            # A form or a template is named only; its content is a file of its own.
            yield _tag(node), owner, (node.text or "").strip(), None, None, None
            continue
        name = _text(properties, "Name") or ""
        yield _tag(node), owner, name, _synonym(properties), _text(properties, "Comment"), _type_list(_one(properties, "Type"))
        path = name if owner is None else f"{owner}/{name}"
        todo += [(child, path) for child in (_one(node, "ChildObjects") or ())]


def objects(df: DataFrame, key: str, xml: str) -> DataFrame:
    """The object of each descriptor and all below it: kind, path of the owner, name, synonym, comment, types."""
    return parsed(df, key, xml, _object_rows, "kind string, owner string, name string, synonym string, remark string, types string")


# --- forms ----------------------------------------------------------------------------------------------------


def _event_rows(node: ET.Element, source: str) -> Iterator[tuple]:
    for k, event in enumerate(_all(_one(node, "Events"), "Event")):
        yield "event", source, event.get("name"), k, None, (event.text or "").strip() or None


def _control_rows(node: ET.Element, parent: str) -> Iterator[tuple]:
    controls = [c for c in (_one(node, "ChildItems") or ()) if c.get("name")]
    for k, control in enumerate(controls):
        path = f"{parent}/{control.get('name')}"
        yield "control", parent, control.get("name"), k, _tag(control), _text(control, "DataPath")
        yield from _event_rows(control, path)
        yield from _control_rows(control, path)


def _form_rows(root: ET.Element) -> Iterator[tuple]:
    yield from _event_rows(root, "Form")
    yield from _control_rows(root, "Form")
    for k, attribute in enumerate(_all(_one(root, "Attributes"), "Attribute")):
        yield "attribute", "Form", attribute.get("name"), k, None, _type_list(_one(attribute, "Type"))
    for k, command in enumerate(_all(_one(root, "Commands"), "Command")):
        yield "command", "Form", command.get("name"), k, None, _text(command, "Action")


def forms(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Controls, events, attributes and commands of each form.

    ``owner`` is the path of the control that holds the row, ``place`` its order
    there, ``tag`` a control's kind, ``bound`` its data path, an event's or
    command's handler, or an attribute's types.
    """
    return parsed(df, key, xml, _form_rows, "what string, owner string, name string, place long, tag string, bound string")


# --- rights, predefined values, subscriptions, identifiers ----------------------------------------------------


def _right_rows(root: ET.Element) -> Iterator[tuple]:
    for thing in _all(root, "object"):
        for right in _all(thing, "right"):
            condition = _text(right, "restrictionByCondition", "condition")
            yield _text(thing, "name"), _text(right, "name"), (_text(right, "value") or "").lower() in ("true", "1"), condition


def rights(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Object, right, whether it is granted, and the condition that restricts it."""
    return parsed(df, key, xml, _right_rows, "object string, right_name string, granted boolean, condition string")


def _item_rows(node: ET.Element, parent: str | None) -> Iterator[tuple]:
    for item in _all(node, "Item"):
        name = _text(item, "Name") or ""
        path = name if parent is None else f"{parent}/{name}"
        flags = [f.get("ref", "").rpartition(".")[2] for f in _all(_one(item, "AccountingFlags"), "Flag") if (f.text or "").strip() == "true"]
        kinds = [t.get("name", "").rpartition(".")[2] for t in _all(_one(item, "ExtDimensionTypes"), "ExtDimensionType")]
        yield path, parent, _text(item, "Code"), _text(item, "Description"), _text(item, "AccountType"), ",".join(flags), ",".join(kinds)
        below = _one(item, "ChildItems")
        if below is not None:
            yield from _item_rows(below, path)


def predefined(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Predefined items as a tree: path, parent, code, description, account type, flags that are set, extra dimensions."""
    return parsed(df, key, xml, lambda root: _item_rows(root, None), "path string, parent string, code string, description string, account_type string, flags string, dimensions string")


def _subscription_rows(root: ET.Element) -> Iterator[tuple]:
    properties = next((_one(n, "Properties") for n in root.iter() if _tag(n) == "EventSubscription"), None)
    if properties is None:
        return
    module, _, procedure = (_text(properties, "Handler") or "").removeprefix("CommonModule.").partition(".")
    for source in (_type_list(_one(properties, "Source")) or "").split(","):
        yield _text(properties, "Name"), _text(properties, "Event"), source or None, module or None, procedure or None


def subscriptions(df: DataFrame, key: str, xml: str) -> DataFrame:
    """One row for each source type of a subscription, with its event and the module and procedure that handle it."""
    return parsed(df, key, xml, _subscription_rows, "name string, event string, source string, module string, procedure string")


def _identifier_rows(root: ET.Element) -> Iterator[tuple]:
    seen: set[str] = set()
    for node in root.iter():
        name, number = node.get("name"), node.get("id")
        if _tag(node) == "Metadata" and name and number and name not in seen:
            seen.add(name)
            yield name, number


def identifiers(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Name and identifier of each entry of a dump's table, nested ones too; the first of a name stays."""
    return parsed(df, key, xml, _identifier_rows, "name string, guid string")
