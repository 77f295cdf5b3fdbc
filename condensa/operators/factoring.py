"""Runs of lines that begin or end alike, written once: `prefix: a; b; c` and `a / b / c + suffix`.

Which lines go together is decided for a whole run at once: of all ways to cut it into groups and single lines, the
one that saves most words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Least lines of a group, words they share and characters of those.
LINES, WORDS, CHARS = 3, 2, 4
#: A line that may be grouped: two words or more, single spaces, none of the marks that groups are written with.
_PLAIN = re.compile(r"[^\s;/+]+(?: [^\s;/+]+)+\Z")
_BULLET = re.compile(r"([-*] |[0-9]+[.)] )(.*)\Z", re.DOTALL)


def _shared(items: list[list[str]]) -> np.ndarray:
    """How many words each item begins with that the one before it has too, leaving each a word of its own."""
    out = np.zeros(len(items), np.int64)
    for i in range(1, len(items)):
        a, b = items[i - 1], items[i]
        most, k = min(len(a), len(b)) - 1, 0
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def best_cuts(items: list[list[str]]) -> tuple[int, list[tuple[int, int, str, int]]]:
    """The most words that grouping can save in a run of lines, given as words, and the groups (first, end, kind, shared words).

    A group of m lines that share k words saves (m - 1) * k. The lines before each end are tried as
    beginnings together, those that still share enough; ties go to the later beginning, and to prefixes."""
    n = len(items)
    best, choice = np.zeros(n + 1, np.int64), [(0, "", 0)] * (n + 1)
    least = {kind: np.zeros(n, np.int64) for kind in ("prefix", "suffix")}
    shared = {"prefix": _shared(items), "suffix": _shared([w[::-1] for w in items])}
    low = dict.fromkeys(least, 0)
    for j in range(1, n + 1):
        best[j], choice[j] = best[j - 1], (j - 1, "", 0)
        for kind, run in least.items():
            run[j - 1] = 1 << 40  # of the line by itself
            if j > 1:
                np.minimum(run[low[kind] : j - 1], shared[kind][j - 1], out=run[low[kind] : j - 1])
                # beginnings that share too little with the end will never share more
                low[kind] += int(np.searchsorted(run[low[kind] : j - 1], WORDS))
            at = np.arange(low[kind], j - LINES + 1)
            if len(at):
                saved = best[at] + run[at] * (j - at - 1)
                k = len(at) - 1 - int(np.argmax(saved[::-1]))
                if saved[k] > best[j]:
                    best[j], choice[j] = saved[k], (int(at[k]), kind, int(run[at[k]]))
    groups, j = [], n
    while j:
        first, kind, k = choice[j]
        if kind:
            groups.append((first, j, kind, k))
        j = first
    return int(best[n]), groups[::-1]


def _written(items: list[list[str]], kind: str, k: int) -> str:
    if kind == "prefix":
        return " ".join(items[0][:k]) + ": " + "; ".join(" ".join(w[k:]) for w in items)
    return " / ".join(" ".join(w[: len(w) - k]) for w in items) + " + " + " ".join(items[0][-k:])


def factored(text: str, bullets: bool = False) -> tuple[str, list[dict[str, int]], int]:
    """The text with groups of lines written once, the place of each such line with the words its lines share (negative: at
    their ends), and the words saved. With bullets, only items of lists are grouped, and their bullets go with the first."""
    out, marks, saved, run = [], [], 0, []

    def close() -> None:
        nonlocal saved
        items = [words for _, words in run]
        gain, groups = best_cuts(items)
        saved += gain
        at = 0
        for first, end, kind, k in [*groups, (len(run), len(run), "", 0)]:
            out.extend(line for line, _ in run[at:first])
            if kind:
                if len(" ".join(items[first][:k] if kind == "prefix" else items[first][-k:])) < CHARS:
                    out.extend(line for line, _ in run[first:end])
                    saved -= (end - first - 1) * k
                else:
                    bullet = _BULLET.match(run[first][0]).group(1) if bullets else ""
                    out.append(bullet + _written(items[first:end], kind, k))
                    marks.append({"line": len(out) - 1, "words": k if kind == "prefix" else -k})
            at = end
        run.clear()

    same = ""
    for line in text.split("\n"):
        m = _BULLET.match(line)
        body, mark = (m.group(2), m.group(1)) if m and bullets else (line, "")
        # numbered items have different bullets, so they couldn't be restored
        fits = (mark in ("- ", "* ") if bullets else m is None) and _PLAIN.match(body)
        if not fits or mark != same:
            close()
        same = mark
        if fits:
            run.append((line, body.split(" ")))
        else:
            out.append(line)
    close()
    return "\n".join(out), marks, saved


def expanded(text: str, marks: list[dict[str, int]]) -> str:
    """The text before it was factored."""
    shared, out = {m["line"]: m["words"] for m in marks}, []
    for i, line in enumerate(text.split("\n")):
        if not (k := shared.get(i, 0)):
            out.append(line)
            continue
        bullet = line[:2] if line[:2] in ("- ", "* ") else ""
        words = line[len(bullet) :].split(" ")
        if k > 0:
            prefix = " ".join(words[:k])[:-1]
            out += [f"{bullet}{prefix} {x}" for x in " ".join(words[k:]).split("; ")]
        else:
            suffix = " ".join(words[k:])
            out += [f"{bullet}{x} {suffix}" for x in " ".join(words[: k - 1]).split(" / ")]
    return "\n".join(out)


def factored_lines(docs: DataFrame, bullets: bool = False, key: str = "doc_id") -> DataFrame:
    """key, text, marks and saved (words) of docs, each text by itself; expanded() gives the text back from its marks.

    Lines with marks that groups are written with (semicolon, slash, plus sign), double spaces or a single
    word stay as they are and end a run, as do placeholders' lines where they share nothing. Null texts stay
    null; a text without groups stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, [], 0) if t is None else factored(t, bullets) for t in batch.column(1).to_pylist()]
            text, marks, saved = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(marks, pa.list_(pa.struct([("line", pa.int32()), ("words", pa.int32())]))), pa.array(saved, pa.int64())], [key, "text", "marks", "saved"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, text string, marks array<struct<line:int,words:int>>, saved bigint")
