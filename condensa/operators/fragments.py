"""Repeated fragments of a text: windows of tokens that recur, extended as far as all their places agree, and
the later copies taken out."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Least tokens of a fragment by the tokens of a text.
SIZES = ((5000, 15), (2000, 18), (0, 20))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = regex.compile(r"[^ \t\n\r\f\v]+")


def least_tokens(n: int) -> int:
    return next(size for over, size in SIZES if n > over or not over)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def fragments(tokens: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of `least` tokens that stands twice or more: its first place, how many places it has, and how many tokens
    agree at all of them; and all places, window by window.

    Windows are compared by 64-bit hashes of token numbers; how far two places agree is searched
    by halves in hashes of prefixes, all places together, so a text of n tokens takes n log n steps."""
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < 2 * least:
        return none, none, none, none
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.uint64, n)
    with np.errstate(over="ignore"):
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(_spread(ids + np.uint64(1)) * power[:n])))
        # a stretch's hash is moved to one power, so that equal stretches are equal wherever they stand
        stretch = lambda at, size: (prefix[at + size] - prefix[at]) * power[n - at]
        at = np.arange(n - least + 1)
        hashes = stretch(at, least)
        order = np.argsort(hashes, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
        count = np.diff(np.concatenate((begin, [len(order)])))
        places = order[np.repeat(count > 1, count)]
        begin, count = order[begin][count > 1], count[count > 1]
        first = np.repeat(begin, count)
        low, high = np.full(len(places), least), n - np.maximum(places, first)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = stretch(first, np.where(open_, middle, 0)) == stretch(places, np.where(open_, middle, 0))
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    size = np.minimum.reduceat(low, np.concatenate(([0], np.cumsum(count)[:-1]))) if len(count) else none
    return begin, count, size, places


class _Taken:
    """Stretches of tokens, merged where they meet."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        a, b = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]


def later_copies(tokens: list[str], least: int) -> list[tuple[int, int]]:
    """Stretches of tokens that repeat an earlier one, disjoint and in order.

    Fragments are taken by the number of their places, then by length, then by place; the first place of one
    is kept, and a later one goes unless it meets something kept or gone."""
    begin, count, size, places = fragments(tokens, least)
    upto = np.concatenate(([0], np.cumsum(count)))
    kept, gone = _Taken(), _Taken()
    cut: list[tuple[int, int]] = []
    for k in np.lexsort((begin, -size, -count)).tolist():
        own, length = places[upto[k] : upto[k + 1]].tolist(), int(size[k])
        if gone.meets(own[0], own[0] + length):
            continue
        kept.add(own[0], own[0] + length)
        for start in own[1:]:
            if not kept.meets(start, start + length) and not gone.meets(start, start + length):
                gone.add(start, start + length)
                cut.append((start, start + length))
    return sorted(cut)


def _rowwise(docs: DataFrame, key: str, schema: str, one) -> DataFrame:
    """Rows of one(text) behind each text's key."""
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *row) for i, text in enumerate(batch.column(1).to_pylist()) for row in one(text)]
            if found:
                rows, *columns = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns)], names)

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {schema}")


def repeated_fragments(docs: DataFrame, least: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, first, n and size: each window of tokens that a text has twice or more, with its first place, its places and the
    number of tokens in which all of them agree from there on.

    Tokens are split at ASCII white space; without `least` it follows the length of the text. Null, empty and short texts
    have no rows; windows may overlap, as in a run of equal tokens."""

    def one(text: str | None) -> list[tuple[int, int, int]]:
        tokens = _SPLIT.findall(text or "")
        begin, count, size, _ = fragments(tokens, least or least_tokens(len(tokens)))
        return list(zip(begin.tolist(), count.tolist(), size.tolist()))

    return _rowwise(docs, key, "first bigint, n bigint, size bigint", one)


def without_copies(docs: DataFrame, least: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, text and n_removed (tokens): texts without later copies of their repeated fragments.

    What stands between tokens stays, but for the white space inside a copy; where a copy goes, the space behind it
    stays in its place. Null texts stay null."""

    def one(text: str | None) -> list[tuple[str | None, int]]:
        if text is None:
            return [(None, 0)]
        places = [m.span() for m in _SPLIT.finditer(text)]
        cut = later_copies([text[a:b] for a, b in places], least or least_tokens(len(places)))
        out, at = [], 0
        for a, b in cut:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
        return [("".join(out) + text[at:], sum(b - a for a, b in cut))]

    return _rowwise(docs, key, "text string, n_removed bigint", one)
