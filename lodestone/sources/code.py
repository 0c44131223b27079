"""Scanner of module sources in both keyword languages: routines with their documentation, and call sites.

A source is cut into tokens by one pattern (comments, strings that may run over lines,
dates, directives, areas, words), and a small state machine reads the tokens once: what
stands in a comment, a string or a preprocessor line is never code. Modules are rows;
a batch of them is scanned in a task, a module at a time.

Defined cases: a null source has no rows; a header without its closing bracket ends with
the text; a routine without its end ends at the next header or with the text; area ends
without an area are passed over. Line breaks of any kind count as one.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Keywords in both languages, lower-cased.
PROCEDURE, FUNCTION = ("процедура", "procedure"), ("функция", "function")
ENDS = {"Procedure": ("конецпроцедуры", "endprocedure"), "Function": ("конецфункции", "endfunction")}
ASYNC = ("асинх", "async")
EXPORT = ("экспорт", "export")
BY_VALUE = ("знач", "val")
AREA, AREA_END = ("область", "region"), ("конецобласти", "endregion")
DECORATORS = ("перед", "после", "вместо", "изменениеиконтроль", "before", "after", "around", "changeandvalidate")
EXECUTE = ("выполнить", "вычислить", "execute", "evaluate")
NOTIFY = ("описаниеоповещения", "notificationdescription")
THIS = ("этотобъект", "thisobject")
NEW = ("новый", "new")
#: Words that stand before a bracket and call nothing.
PLAIN = frozenset(
    "если иначеесли пока для каждого из по цикл и или не возврат тогда процедура функция новый if elsif while for each in to do and or not return then procedure function new".split()
)
PARAMETERS, RETURNS = ("параметры:", "parameters:"), ("возвращаемое значение:", "returns:")
#: Blanks that are no white space, a byte order mark and a joiner.
UNSEEN = "\ufeff\u200b\u00a0"

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"]|"")*(?:"|\Z))|(?P<date>'[^'\n]*'?)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<number>\d[\d.]*)|(?P<line>\n)|(?P<mark>[^\s\ufeff\u200b])""",
    re.DOTALL,
)


@dataclass
class Routine:
    line: int
    kind: str
    name: str
    parameters: list[tuple[str, bool, str | None]]
    export: bool
    directives: list[str]
    area: str | None
    description: str
    doc_parameters: str
    doc_returns: str
    header: str
    body: str = ""
    calls: list[tuple] = field(default_factory=list)

    def decorator(self) -> tuple[str | None, str | None]:
        """Kind and target of the first directive that extends a routine of another module."""
        for d in self.directives:
            m = re.match(r'&\s*(\w+)\s*\(\s*"([^"]+)"', d)
            if m and m[1].lower() in DECORATORS:
                return m[1], m[2]
        return None, None


def doc_sections(lines: list[str]) -> tuple[str, str, str]:
    """Description, parameters and result of the comment above a header."""
    low = [x.strip().lower() for x in lines]
    at = lambda marks: next((k for k, x in enumerate(low) if x in marks), None)
    p, r = at(PARAMETERS), at(RETURNS)
    first = min((x for x in (p, r) if x is not None), default=len(lines))
    join = lambda a, b: "\n".join(lines[a:b])
    parameters = join(p + 1, r if r is not None and r > p else len(lines)).rstrip() if p is not None else ""
    return join(0, first).strip(), parameters, join(r + 1, len(lines)).rstrip() if r is not None else ""


def inner_call(text: str) -> tuple[str | None, str, int] | None:
    """Qualifier, name and number of arguments of a call that a string holds."""
    m = re.match(r"\s*(?:([\w.]+)\s*\.\s*)?(\w+)\s*\(", text)
    if not m:
        return None
    return m[1], m[2], _arguments(list(TOKEN.finditer(text, m.end())), 0)[1]


def _arguments(tokens: list[re.Match], at: int) -> tuple[int, int, int]:
    """From the token after an opening bracket on: arguments, those that are not empty, and the token that closes it."""
    depth, n, filled, here = 0, 0, 0, False
    for k in range(at, len(tokens)):
        c = tokens[k].group()
        if c in (")", "]") and depth == 0:
            return n + (here or n > 0), filled + here, k
        depth += (c in ("(", "[")) - (c in (")", "]"))
        if c == "," and depth == 0:
            n, filled, here = n + 1, filled + here, False
        elif tokens[k].lastgroup not in ("line", "comment", "block"):
            here = True
    return n + (here or n > 0), filled + here, len(tokens)


def _value(literal: str) -> str:
    return literal[1:-1].replace('""', '"') if len(literal) > 1 and literal.endswith('"') else literal[1:]


class Scanner:
    def __init__(self, source: str):
        self.source = source.replace("\r\n", "\n").replace("\r", "\n")
        self.tokens = [t for t in TOKEN.finditer(self.source) if t.lastgroup != "block"]
        self.lines = self.source.split("\n")
        self.starts = [0]
        for x in self.lines[:-1]:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def line(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)

    def _doc(self, line: int) -> list[str]:
        """Comment lines right above a header and its directives, without their marks."""
        blank = " \t " + UNSEEN
        k, out = line - 2, []
        while k >= 0 and self.lines[k].lstrip(blank).startswith("&"):
            k -= 1
        while k >= 0 and (x := self.lines[k].lstrip(blank)).startswith("//"):
            out.append((x[3:] if x.startswith("// ") else x[2:]).rstrip())
            k -= 1
        return out[::-1]

    def routines(self) -> list[Routine]:
        out: list[Routine] = []
        area: list[str] = []
        directives: list[str] = []
        now: Routine | None = None
        begun, fresh, k = 0, True, 0  # where the open body began; at a line's first token
        tokens = self.tokens
        while k < len(tokens):
            t = tokens[k]
            kind, text = t.lastgroup, t.group()
            if kind == "line":
                fresh, k = True, k + 1
                continue
            if kind == "comment":
                k += 1
                continue
            first, fresh = fresh, False
            if first and text in ("#", "&"):
                stop = self.source.find("\n", t.start())
                stop = len(self.source) if stop < 0 else stop
                said = self.source[t.start() : stop].strip()
                if text == "&":
                    directives.append(said.partition("//")[0].strip())
                else:
                    word, _, rest = said[1:].strip().partition(" ")
                    if word.lower() in AREA:
                        area.append(rest.strip())
                    elif word.lower() in AREA_END and area:
                        area.pop()
                while k < len(tokens) and tokens[k].start() < stop:
                    k += 1
                continue
            low = text.lower()
            if kind == "word" and first:
                ahead = k + 1 if low in ASYNC and k + 1 < len(tokens) else k
                word = tokens[ahead].group().lower()
                if word in PROCEDURE or word in FUNCTION:
                    if now:
                        now.body = self.source[begun : t.start()].strip("\n")
                    now, k = self._header(ahead, t, "Procedure" if word in PROCEDURE else "Function", directives, area)
                    out.append(now)
                    begun = tokens[k - 1].end() if k else t.end()
                    directives = []
                    continue
            if kind == "word" and now and low in ENDS[now.kind]:
                now.body = self.source[begun : t.start()].strip("\n")
                now, k = None, k + 1
                continue
            directives = []
            k = self._call(k, now) if kind == "word" and now else k + 1
        if now:
            now.body = self.source[begun:].strip("\n")
        return out

    def _header(self, at: int, t: re.Match, kind: str, directives: list[str], area: list[str]) -> tuple[Routine, int]:
        tokens = self.tokens
        name = tokens[at + 1].group() if at + 1 < len(tokens) and tokens[at + 1].lastgroup == "word" else ""
        k = at + 1
        while k < len(tokens) and tokens[k].group() != "(" and tokens[k].lastgroup != "line":
            k += 1
        parameters: list[tuple[str, bool, str | None]] = []
        if k < len(tokens) and tokens[k].group() == "(":
            stop = _arguments(tokens, k + 1)[2]
            item: list[re.Match] = []
            depth = 0
            for x in [*tokens[k + 1 : stop], None]:
                if x is None or (x.group() == "," and depth == 0):
                    if item:
                        parameters.append(self._parameter(item))
                    item = []
                elif x.lastgroup not in ("line", "comment"):
                    depth += (x.group() in "([") - (x.group() in ")]") if x.lastgroup == "mark" else 0
                    item.append(x)
            k = stop + 1
        export = k < len(tokens) and tokens[k].group().lower() in EXPORT
        k = min(k + export, len(tokens))
        line = self.line(t.start())
        header = self.source[t.start() : tokens[k - 1].end()]
        return Routine(line, kind, name, parameters, bool(export), directives, ".".join(area) or None, *doc_sections(self._doc(line)), header), k

    def _parameter(self, item: list[re.Match]) -> tuple[str, bool, str | None]:
        by_value = len(item) > 1 and item[0].group().lower() in BY_VALUE
        item = item[by_value:]
        default = None
        if len(item) > 1 and item[1].group() == "=":
            default = self.source[item[1].end() : item[-1].end()].strip()
        return item[0].group(), by_value, default

    def _call(self, k: int, now: Routine) -> int:
        """The call that begins with the word at ``k``, if one does; where to go on."""
        tokens, begin = self.tokens, self.tokens[k]
        low, line = begin.group().lower(), self.line(begin.start())
        after = lambda j, c: j < len(tokens) and tokens[j].group() == c
        literal = k + 2 < len(tokens) and after(k + 1, "(") and tokens[k + 2].lastgroup == "string"
        if low in EXECUTE and literal:
            found = inner_call(_value(tokens[k + 2].group()))
            if found:
                now.calls.append((line, "dynamic", *found))
                return k + 3
        if low in NOTIFY and literal and (name := _value(tokens[k + 2].group())):
            own = after(k + 3, ",") and k + 4 < len(tokens) and tokens[k + 4].group().lower() in THIS
            now.calls.append((line, "notification", tokens[k + 4].group() if own else None, name, None))
            return k + 3
        chain, j = [begin.group()], k + 1
        while after(j, ".") and j + 1 < len(tokens) and tokens[j + 1].lastgroup == "word":
            chain.append(tokens[j + 1].group())
            j += 2
        if not after(j, "("):
            return j
        made = k > 0 and tokens[k - 1].group().lower() in NEW  # a constructor
        if not made and (len(chain) > 1 or low not in PLAIN):
            n = _arguments(tokens, j + 1)[0]
            now.calls.append((line, "qualified" if len(chain) > 1 else "direct", ".".join(chain[:-1]) or None, chain[-1], n))
        return j + 1


ROUTINES = "line int, kind string, name string, parameters array<struct<name string, by_value boolean, default string>>, export boolean, directives array<string>, decorator string, target string, area string, description string, doc_parameters string, doc_returns string, header string, body string, body_sha256 string"
CALLS = "caller string, caller_line int, line int, kind string, qualifier string, name string, arguments int"


def _over(df: DataFrame, key: str, text: str, columns: str, rows) -> DataFrame:
    names = [key, *StructType.fromDDL(columns).names]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(pdf[key], pdf[text]) if t for x in Scanner(t).routines() for r in rows(x)], columns=names)

    return df.select(key, text).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, {columns}")


def routines(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each routine of each source."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = lambda x: (x.line, x.kind, x.name, [dict(zip(("name", "by_value", "default"), p)) for p in x.parameters], x.export, x.directives, *x.decorator(), x.area, x.description, x.doc_parameters, x.doc_returns, x.header, x.body, digest(x.body))
    return _over(df, key, text, ROUTINES, lambda x: [row(x)])


def calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each call site of each routine: direct, qualified, dynamic (in an executed string) or notification."""
    return _over(df, key, text, CALLS, lambda x: [(x.name, x.line, *c) for c in x.calls])
