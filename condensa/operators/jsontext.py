"""JSON values inside prose: found, taken apart by path policies, and put together again.

A text is cut into parts: prose, JSON as it is spelled, and JSON strings that may be rewritten.
Parts are rows, so any column expression may rewrite prose and strings; joined in order they
give the text again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tokens of JSON, and white space between them.
TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|((?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|true|false|null|NaN|-?Infinity))')
#: Halves of surrogate pairs, which can be escaped in JSON, but not written as UTF-8; such strings stay as they are spelled.
HALF = re.compile("[\ud800-\udfff]")
#: A policy that keeps all strings and takes spaces away.
KEEP = {"default": False, "minify": True}


def scanned(text: str, start: int, ends: dict[int, int]) -> list[tuple[str, int, int, tuple[str, ...]]]:
    """Tokens (kind, first, end, path) of the value that begins with the brace at start; none if it isn't whole.

    ends gets the end of every value with braces met on the way, 0 of those that have none, so that no brace
    is read again from within the one around it."""
    out: list[tuple[str, int, int, tuple[str, ...]]] = []
    open_: list[list] = []  # place, brace, path, key or number of the next value
    want, at = "value", start
    while True:
        if (m := TOKEN.match(text, at)) is None:
            break
        mark, string, plain = m.groups()
        first, at = m.start(m.lastindex), m.end()
        top = open_[-1] if open_ else None
        path = (*top[2], str(top[3])) if top and (top[1] == "[" or want != "key") else top[2] if top else ()
        if mark in ("{", "[") and "value" in want:
            open_.append([first, mark, path, 0])
            out.append(("open", first, at, path))
            want = "key or end" if mark == "{" else "value or end"
        elif mark in ("}", "]") and top and mark == ("}" if top[1] == "{" else "]") and ("end" in want):
            open_.pop()
            ends[top[0]] = at
            out.append(("close", first, at, top[2]))
            if not open_:
                return out
            want = "comma or end"
        elif string and "key" in want:
            top[3] = json.loads(string)
            out.append(("key", first, at, (*top[2], top[3])))
            want = "colon"
        elif (string or plain) and "value" in want:
            out.append(("string" if string else "literal", first, at, path))
            want = "comma or end"
        elif mark == ":" and want == "colon":
            out.append(("colon", first, at, path))
            want = "value"
        elif mark == "," and "comma" in want:
            out.append(("comma", first, at, path))
            if top[1] == "[":
                top[3] += 1
            want = "key" if top[1] == "{" else "value"
        else:
            break
    for brace in open_:
        ends[brace[0]] = 0
    return []


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of the outermost JSON objects and arrays of a text, from left to right."""
    ends: dict[int, int] = {}
    at = 0
    for m in re.finditer(r"[{\[]", text):
        if (first := m.start()) < at:
            continue
        if first not in ends:
            scanned(text, first, ends)
        if end := ends.get(first, 0):
            yield first, end
            at = end


def path_pattern(pattern: str) -> re.Pattern:
    """A pattern of a path, segments by full stops, as a regular expression of the segments, each behind a null character:
    * is one segment, ** any number of them; the empty pattern is the whole value."""
    kinds = {"*": r"\x00[^\x00]*", "**": r"(?:\x00[^\x00]*)*"}
    return re.compile("".join(kinds.get(s, r"\x00" + re.escape(s)) for s in pattern.split(".") if s) + r"\Z")


def _allowed(policy: Mapping) -> list[tuple[re.Pattern, bool]]:
    rules = policy.get("overrides") or {}
    return [(path_pattern(p), a) for p, a in sorted(rules.items(), key=lambda x: -len(x[0]))] + [(re.compile(""), bool(policy.get("default")))]


def parts(docs: DataFrame, policy: Mapping = KEEP, key: str = "doc_id") -> DataFrame:
    """key, part (from 0), kind, path and text: what each text is made of, in order.

    kind is `prose`, `json` (kept as it is spelled) or `string`, the content of a string that the policy lets be
    rewritten; json around it has no quotes for it. A policy has default and overrides (path pattern to boolean,
    the longest that fits decides) for strings, and minify: without spaces, or with one after commas and colons.
    A null text has no part, an empty one an empty part of prose. Rows are taken apart where they lie."""
    rules, minify = _allowed(policy), bool(policy.get("minify") or policy.get("default"))
    gap = {"comma": "," if minify else ", ", "colon": ":" if minify else ": "}

    def cut(text: str) -> list[tuple[str, str, str]]:
        out, at, kept = [], 0, []

        def flush() -> None:
            if kept:
                out.append(("json", "", "".join(kept)))
                kept.clear()

        for first, end in blocks(text):
            if first > at:
                out.append(("prose", "", text[at:first]))
            for kind, a, b, path in scanned(text, first, {}):
                joined = "".join(f"\x00{p}" for p in path)
                if kind == "string" and next(allow for rule, allow in rules if rule.match(joined)) and not HALF.search(joined + (content := json.loads(text[a:b]))):
                    flush()
                    out.append(("string", ".".join(path), content))
                else:
                    kept.append(gap.get(kind, text[a:b]))
            flush()
            at = end
        return out + [("prose", "", text[at:])] if at < len(text) or not out else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    kind, path, part = zip(*cut(text))
                    n = len(kind)
                    columns = [pa.array(range(n), pa.int32()), pa.array(kind), pa.array(path), pa.array(part)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n, pa.int32())), *columns], [key, "part", "kind", "path", "text"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, part int, kind string, path string, text string")


def _literal(text: Column) -> Column:
    """A JSON string, escaped as little as JSON asks for."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        text = F.replace(text, F.lit(c), F.lit(f"\\{name}"))
    control = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i)
    plain = F.aggregate(control, text, lambda t, i: F.replace(t, F.char(i), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(i)), 4, "0"))))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), plain).otherwise(text), F.lit('"'))


def joined(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text of rows as parts() gives them, whatever has become of their texts: strings are quoted and escaped
    anew, the rest is joined as it is, in order. Keys have to be different for different texts."""
    text = F.when(F.col("kind") == "string", _literal(F.col("text"))).otherwise(F.col("text"))
    return rows.select(key, F.struct("part", text.alias("t")).alias("p")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("text"))
