"""Parsers of files and texts into rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = {"br", "hr", "img", "input", "link", "meta"}


def file_index(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, kind and size of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("kind"), F.col("length").alias("size"))


def binary_text(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file and the printable runs of its bytes, for modules stored in binary containers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.decode("content", "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]{6,}"), F.lit(0))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(runs).alias("part", "run"))


#: The upper half of a one-byte code page, as Latin-1 reads it and as Windows-1251 does.
_HIGH = bytes(range(128, 256)).decode("latin-1")
_CYRILLIC = bytes(range(128, 256)).decode("cp1251", "replace")


def sniffed(data: Column) -> Column:
    """Bytes as text: UTF-8 with or without its mark, else Windows-1251."""
    marked = F.hex(F.substring(data, 1, 3)) == "EFBBBF"
    body = F.when(marked, F.expr("NULL").cast("binary")).otherwise(data)
    plain = F.try_validate_utf8(body.cast("string"))
    return F.when(marked, F.substring(data.cast("string"), 2, 1 << 30)).otherwise(F.coalesce(plain, F.translate(F.decode(data, "ISO-8859-1"), _HIGH, _CYRILLIC)))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, "<(script|style)[^>]*>[^<]*</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


class _Tree(HTMLParser):
    """Rows (number, parent, depth, tag, name) of the elements in order."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int | None, int, str, str | None]] = []
        self.open: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        number = len(self.rows)
        named = dict(attrs)
        self.rows.append((number, self.open[-1][0] if self.open else None, len(self.open), tag, named.get("name") or named.get("id")))
        if tag not in VOID:
            self.open.append((number, tag))

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.open):
            while self.open.pop()[1] != tag:
                pass


def elements(df: DataFrame, key: str, markup: str) -> DataFrame:
    """Element tree of each document of markup."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[markup]):
                tree = _Tree()
                tree.feed(text or "")
                rows += [(k, *r) for r in tree.rows]
            out = pd.DataFrame(rows, columns=[key, "number", "parent", "depth", "tag", "name"])
            out["parent"] = out["parent"].astype("Int64")
            yield out

    kind = dict(df.dtypes)[key]
    return df.select(key, markup).mapInPandas(work, f"{key} {kind}, number long, parent long, depth int, tag string, name string")


def indented(df: DataFrame, key: str, text: str) -> DataFrame:
    """Paths and values of a report whose indentation is its tree; quoted values may span lines."""

    def rows_of(report: str) -> Iterator[tuple[str, str]]:
        stack: list[tuple[int, str]] = []
        lines = iter(report.split("\n"))
        for line in lines:
            if not line.strip():
                continue
            depth = len(line) - len(line.lstrip())
            name, _, value = line.strip().partition(":")
            value = value.strip()
            while value.startswith('"') and not (len(value) > 1 and value.endswith('"')):
                more = next(lines, None)
                if more is None:
                    break
                value += "\n" + more
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, name))
            yield "/".join(n for _, n in stack), value.strip('"')

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, p, v) for k, t in zip(pdf[key], pdf[text]) for i, (p, v) in enumerate(rows_of(t or ""))], columns=[key, "number", "path", "value"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(work, f"{key} {kind}, number int, path string, value string")


ROUTINE = re.compile(r"\s*(procedure|function)\s+(\w+)\s*\(", re.IGNORECASE)
CALL = re.compile(r"(?:(\w+)\.)?(\w+)\s*\(")
#: Words before a bracket that call nothing.
NO_CALL = {"if", "elsif", "while", "for", "return", "and", "or", "not", "in", "new", "procedure", "function"}


def split_arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments after the bracket that opens before ``start``, and the place behind the one that closes it.

    Commas within brackets or quotes part nothing; a doubled quote stands for itself.
    """
    out, depth, quoted, now = [], 0, False, []
    i = start
    while i < len(text):
        c = text[i]
        if c == '"':
            quoted = not quoted
        if not quoted and c in ")]" and depth == 0:
            break
        if not quoted:
            depth += (c in "([") - (c in ")]")
        if c == "," and not quoted and depth == 0:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    last = "".join(now).strip()
    return (out + [last] if out or last else out), i + 1


def _bare(line: str) -> str:
    """The line without a comment behind it, its quoted parts blank."""
    out, quoted = [], False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
            out.append(c)
        elif not quoted and line.startswith("//", i):
            break
        else:
            out.append(" " if quoted else c)
    return "".join(out)


def _scan(source: str) -> Iterator[tuple]:
    directive, doc = None, []
    lines = source.split("\n")
    number = 0
    while number < len(lines):
        line = lines[number]
        number += 1
        stripped = line.strip()
        if stripped.startswith("//"):
            doc.append(stripped[2:].strip())
            continue
        if stripped.startswith("&"):
            directive = stripped[1:]
            yield number, "directive", directive, None, 0, None
            continue
        head = ROUTINE.match(line)
        if head:
            first = number
            # A header may run over lines, up to the bracket that closes it.
            while (split := split_arguments(line, head.end()))[1] > len(line) and number < len(lines):
                line += "\n" + lines[number]
                number += 1
            params, end = split
            yield first, "routine", head[2], "export" if re.match(r"\s*export\b", line[end:], re.IGNORECASE) else directive, len(params), " ".join(doc) or None
            for param in params:
                name, _, default = param.partition("=")
                by_value = re.match(r"val\s+", name, re.IGNORECASE)
                yield first, "parameter", name[by_value.end() if by_value else 0 :].strip(), "val" if by_value else None, 0, default.strip() or None
            directive, doc = None, []
            continue
        if stripped:
            doc = []
        plain = _bare(line)
        for call in CALL.finditer(plain):
            if call[2].lower() not in NO_CALL:
                yield number, "call", call[2], call[1], len(split_arguments(plain, call.end())[0]), None


def code_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """Routines, their parameters, directives and call sites, one row each with its line.

    ``qualifier`` is a routine's export mark or else its directive, a
    parameter's ``val``, or what stands before a call's point; ``arguments``
    counts parameters or arguments; ``detail`` is a routine's comment or a
    parameter's default.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(pdf[key], pdf[text]) for r in _scan(t or "")], columns=[key, "line", "kind", "name", "qualifier", "arguments", "detail"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(work, f"{key} {kind}, line int, kind string, name string, qualifier string, arguments int, detail string")
