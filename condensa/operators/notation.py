"""JSON values in an indented notation with tables, for prompts.

A value is first laid out as a list of nodes, parents before children. Tables, folded chains and
aliases are decided on that list; lines are then written from it, with other names and
strings where aliases hold. No function calls itself, so values may be nested to any depth.

An object is `key: value` lines, nested by two spaces; chains of single keys fold into
dotted ones; an array is headed by its length, an array of equal flat objects is a table
under the names of its columns. Strings are quoted where they could be misread. Keys and
strings that recur may become aliases with a legend, where the whole gets shorter.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Delimiters in order of preference, words and numbers that aren't strings, and what asks for quotes.
DELIMITERS = (",", "|", "\t")
RESERVED = ("null", "true", "false")
NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
UNSAFE = re.compile(r"[:\n\r\[\]{}()\\\"]")
#: Short names of columns, the deepest chain folded, and what makes an alias worth while.
SHORT_COLUMNS = {"identifier": "id", "description": "desc", "timestamp": "ts", "quantity": "qty", "reference": "ref", "configuration": "cfg", "enabled": "on", "disabled": "off"}
DEEPEST, ALIAS_LENGTH, ALIAS_USES = 4, 8, 2

_ESCAPES = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"})
_NONE: dict[str, str] = {}


@dataclass
class Node:
    """One value: what it is (object, array or scalar), under which key, and the places of its children."""

    kind: str
    key: str | None = None
    value: object = None
    children: list[int] = field(default_factory=list)


def laid_out(value) -> list[Node]:
    """The nodes of a value, each before its children; children in order."""
    nodes, todo = [], [(None, None, value)]
    while todo:
        parent, key, v = todo.pop()
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "scalar"
        if parent is not None:
            nodes[parent].children.append(len(nodes))
        inside = [(len(nodes), k, x) for k, x in v.items()] if kind == "object" else [(len(nodes), None, x) for x in v] if kind == "array" else []
        nodes.append(Node(kind, key, v if kind == "scalar" else None))
        todo += reversed(inside)
    return nodes


def put_together(nodes: list[Node], names: Mapping[str, str] = _NONE, strings: Mapping[str, str] = _NONE):
    """The value of the nodes, with keys and strings by others where they are named."""
    made: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.kind == "object":
            made[i] = {names.get(nodes[c].key, nodes[c].key): made[c] for c in node.children}
        elif node.kind == "array":
            made[i] = [made[c] for c in node.children]
        else:
            made[i] = strings.get(node.value, node.value) if isinstance(node.value, str) else node.value
    return made[0]


def quoted(text: str, delimiter: str, key: bool = False, dotted: bool = False) -> str:
    """The string as it stands, or in quotes where it could be misread."""
    plain = text and text == text.strip() and not text.startswith("-") and text.lower() not in RESERVED and not NUMBER.match(text) and not UNSAFE.search(text)
    if plain and delimiter not in text and (dotted or not key or "." not in text):
        return text
    return f'"{text.translate(_ESCAPES)}"'


def scalar(value, delimiter: str) -> str:
    if isinstance(value, str):
        return quoted(value, delimiter)
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else format(value, "g") if isinstance(value, float) else str(value)


def best_delimiter(strings: list[str]) -> str:
    """The delimiter with which the fewest strings need quotes, the first of equals."""
    need = {d: sum(quoted(s, d) != s for s in strings) for d in DELIMITERS}
    return min(need, key=need.get)


def _short(names: list[str]) -> list[str]:
    """Short names of columns in the case of the long ones; the long ones if two would be the same."""
    cased = lambda long, new: new if len(new) >= len(long) else new.upper() if long.isupper() else new.capitalize() if long[:1].isupper() else new
    short = [cased(n, SHORT_COLUMNS.get(n.lower(), n)) for n in names]
    return short if len({*short}) == len(short) else names


class Layout:
    """What is decided about nodes before they are written, under given names and strings."""

    def __init__(self, nodes: list[Node], names: Mapping[str, str] = _NONE, strings: Mapping[str, str] = _NONE):
        self.nodes, self.names, self.strings = nodes, names, strings

    def key(self, i: int) -> str:
        return self.names.get(self.nodes[i].key, self.nodes[i].key)

    def value(self, i: int):
        v = self.nodes[i].value
        return self.strings.get(v, v) if isinstance(v, str) else v

    def flat(self, places: list[int]) -> bool:
        return all(self.nodes[c].kind == "scalar" for c in places)

    def columns(self, i: int) -> list[str] | None:
        """The names of an array's columns, if it is a table: two or more objects of the same flat keys."""
        if self.nodes[i].kind != "array":
            return None
        rows = [self.nodes[c] for c in self.nodes[i].children]
        if len(rows) < 2 or any(r.kind != "object" or not self.flat(r.children) for r in rows):
            return None
        names = [self.key(c) for c in rows[0].children]
        return names if all(len(r.children) == len(names) and {self.key(c) for c in r.children} == {*names} for r in rows) else None

    def folded(self, i: int) -> tuple[str, int]:
        """The dotted keys of the chain of single keys that begins at a node, and where it ends; keys that aren't
        plain names, and more than DEEPEST, don't fold."""
        keys, at = [self.key(i)], i
        while len(keys) < DEEPEST and NAME.match(keys[-1]) and keys[-1].lower() not in RESERVED and self.nodes[at].kind == "object" and len(self.nodes[at].children) == 1:
            step = self.nodes[at].children[0]
            if not NAME.match(self.key(step)) or self.key(step).lower() in RESERVED:
                break
            keys.append(self.key(step))
            at = step
        return ".".join(keys), at

    def fields(self, i: int, fold: bool) -> list[tuple[str, int]]:
        """Written name and node of each entry of an object; a folded name that the object has as a key stays unfolded."""
        own, out = {self.key(c) for c in self.nodes[i].children}, []
        for c in self.nodes[i].children:
            dotted, end = self.folded(c) if fold else (self.key(c), c)
            out.append((quoted(dotted, "\n", dotted=True), end) if end != c and dotted not in own else (quoted(self.key(c), "\n", key=True), c))
        return out

    def lines(self) -> list[str]:
        """All lines. What is still to be written is a stack of lines and of (node, depth, what stands before it, its delimiter
        if it is an item of a list)."""
        out: list[str] = []
        todo: list = [(0, 0, None, None)]
        while todo:
            step = todo.pop()
            if isinstance(step, str):
                out.append(step)
                continue
            i, depth, before, item = step
            node, pad = self.nodes[i], "  " * depth
            if node.kind == "array":
                todo += reversed(self._array(i, depth, pad if before is None else before))
            elif node.kind == "scalar":
                out.append(pad + scalar(self.value(i), "\n") if before is None else before + scalar(self.value(i), item) if item else f"{before}: {scalar(self.value(i), chr(10))}")
            elif before is None:
                todo += [(c, depth, pad + name, None) for name, c in reversed(self.fields(i, True))]
            elif not node.children:
                out.append(before + ("{}" if item else ": {}"))
            elif item:
                todo += reversed(self._item(i, depth, before))
            else:
                todo.append((i, depth + 1, None, None))
                out.append(before)
        return out

    def _array(self, i: int, depth: int, head: str) -> list:
        children, names, pad = self.nodes[i].children, self.columns(i), "  " * (depth + 1)
        values = [x for c in children for x in ([c] if self.nodes[c].kind == "scalar" else self.nodes[c].children if self.nodes[c].kind == "object" else []) if isinstance(self.value(x), str)]
        mark = best_delimiter([*(names or []), *map(self.value, values)])
        head += f"[{len(children)}{mark.strip(',')}]"
        if names:
            cells = [{self.key(x): scalar(self.value(x), mark) for x in self.nodes[c].children} for c in children]
            return [f"{head} " + mark.join(quoted(n, mark, key=True) for n in _short(names)), *(pad + mark.join(row[n] for n in names) for row in cells)]
        if names is not None:
            return [head, *[pad] * len(children)]
        if children and self.flat(children):
            return [f"{head}: " + mark.join(scalar(self.value(c), mark) for c in children)]
        return [head, *((c, depth + 1, f"{pad}- ", mark) for c in children)]

    def _item(self, i: int, depth: int, dash: str) -> list:
        """An object in a list: on the line of its dash, if it has one entry or begins with a table."""
        (name, first), *rest = self.fields(i, False)
        if self.nodes[first].kind == "array" and (not rest or self.columns(first) is not None):
            return [(first, depth, dash + name, None), *((c, depth + 1, "  " * (depth + 1) + n, None) for n, c in rest)]
        if rest or self.nodes[first].kind == "array":
            return [dash.rstrip(), *((c, depth + 1, "  " * (depth + 1) + n, None) for n, c in self.fields(i, False))]
        if self.nodes[first].kind == "object":
            return [dash + name, (first, depth + 1, None, None)]
        return [(first, depth, dash + name, None)]


def legend(nodes: list[Node]) -> tuple[dict[str, str], dict[str, str]]:
    """Aliases of keys, but for ids, and of strings that recur: ~k0, ~v0 and so on, the most frequent first."""
    chosen = []
    for prefix, counts in (("~k", Counter(n.key for n in nodes if n.key is not None)), ("~v", Counter(n.value for n in nodes if isinstance(n.value, str)))):
        name = lambda t: t.lower().endswith("id") or t.lower() in ("uuid", "guid", "identifier")
        worth = [(-n, -len(t), t) for t, n in counts.items() if n >= ALIAS_USES and len(t) >= ALIAS_LENGTH and t.lower() not in RESERVED and not NUMBER.match(t) and not (prefix == "~k" and name(t))]
        free = (f"{prefix}{i}" for i in range(len(worth) + len(counts)) if f"{prefix}{i}" not in counts)
        chosen.append({t: a for (_, _, t), a in zip(sorted(worth), free)})
    return chosen[0], chosen[1]


def _table(names: Mapping[str, str], strings: Mapping[str, str]) -> dict[str, dict[str, str]]:
    return {k: {a: t for t, a in found.items()} for k, found in (("k", names), ("v", strings)) if found}


def aliases(value) -> tuple[object, dict[str, dict[str, str]]]:
    """The value with aliases for keys and strings that recur, and what they stand for."""
    nodes = laid_out(value)
    names, strings = legend(nodes)
    return put_together(nodes, names, strings), _table(names, strings)


def restored(value, table: Mapping[str, Mapping[str, str]]):
    """The value that `aliases` changed, as it was."""
    return put_together(laid_out(value), table.get("k", _NONE), table.get("v", _NONE))


def encode(value) -> str:
    """The shorter of the plain notation and the one with aliases and their legend."""
    nodes = laid_out(value)
    names, strings = legend(nodes)
    ways = ["\n".join(Layout(nodes).lines())]
    if names or strings:
        note = "@alias=" + json.dumps(_table(names, strings), ensure_ascii=False, separators=(",", ":"))
        ways.append("\n".join([*Layout(nodes, names, strings).lines(), note]))
    return min(ways, key=len)


def worth_it(value, length: int) -> bool:
    """Whether a block of so many characters is to be converted: from 200 on, or with a table or a list of three."""
    layout = Layout(laid_out(value))
    lists = [i for i, n in enumerate(layout.nodes) if n.kind == "array"]
    return layout.nodes[0].kind != "scalar" and length > 0 and (length >= 200 or any(layout.columns(i) is not None or (len(layout.nodes[i].children) >= 3 and layout.flat(layout.nodes[i].children)) for i in lists))


def notated(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key and the column's JSON text in the notation; what isn't JSON, or nested more than Python reads, and null stay as they are.

    A row is converted by itself, in Arrow batches: there is no shuffle."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else encode(json.loads(text))
        except (ValueError, RecursionError):  # Python's reader nests to a fixed depth
            return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], pa.string())], [key, column])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {column} string")
