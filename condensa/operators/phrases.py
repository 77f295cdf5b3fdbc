"""Replacement by tables of phrases: canonical forms, and dictionaries with a legend.

A few rules stand in the plan as one alternation. A table of phrases becomes a trie in flat
arrays, which a task holds once and walks for all words of a batch of texts together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What is never looked into.
PLACEHOLDER = r"__[A-Za-z]+_[0-9]+__"


def in_case_of(found: Column, new: Column) -> Column:
    """new in the case of what it stands for: capitals, small letters or a capital first; a new form that has
    capitals of its own keeps them."""
    upper, lower = F.upper(found), F.lower(found)
    return (
        F.when(new != F.lower(new), new)
        .when((found == upper) & (upper != lower), F.upper(new))
        .when(found == lower, new)
        .when((F.substring(found, 1, 1) == F.upper(F.substring(found, 1, 1))) & (F.substring(found, 2, 1 << 30) == F.lower(F.substring(found, 2, 1 << 30))), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 30)))
        .otherwise(new)
    )


def _rules(rules: Mapping[str, str]) -> tuple[str, Column, dict[str, str]]:
    clean = {k.strip().lower(): v for k, v in rules.items() if k.strip()}
    return "(?i)" + T.alternation(clean), F.create_map(*[F.lit(x) for kv in clean.items() for x in kv]), clean


def canonical(text: Column, rules: Mapping[str, str]) -> Column:
    """text with the rules' phrases, whole words in any case, by their canonical forms.

    All phrases are found in one scan, leftmost first, then the longest; the case of what
    was found is kept. Null and empty texts stay, as do texts without a match; without
    rules all stay. The rules are part of the plan, so a table of them has to be bounded."""
    if not any(k.strip() for k in rules):
        return text
    pattern, table, _ = _rules(rules)
    return T.replaced(text, pattern, lambda m: in_case_of(m, F.element_at(table, F.lower(m))))


def with_dictionary(text: Column, rules: Mapping[str, str]) -> Column:
    """text and applied: phrases by their symbols behind a line that explains them, where that has fewer tokens.

    Placeholders aren't looked into. The line names the phrases used, longer ones first."""
    if not any(k.strip() for k in rules):
        return F.struct(text.alias("text"), F.lit(False).alias("applied"))
    pattern, table, _ = _rules(rules)
    either = f"{PLACEHOLDER}|{pattern}"
    is_mark = lambda m: m.rlike(f"^{PLACEHOLDER}$")
    body = T.replaced(text, either, lambda m: F.when(is_mark(m), m).otherwise(in_case_of(m, F.element_at(table, F.lower(m)))))
    used = F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(either), F.lit(0)), lambda m: ~is_mark(m)), F.lower))
    ordered = F.transform(F.array_sort(F.transform(used, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda x: F.concat(F.element_at(table, x["p"]), F.lit("="), x["p"]))
    candidate = F.concat(F.lit("[DICT] "), F.array_join(ordered, "; "), F.lit("\n"), body)
    fewer = (F.size(used) > 0) & (T.n_tokens(candidate) < T.n_tokens(text))
    return T.let(F.struct(candidate.alias("c"), fewer.alias("f")), lambda x: F.struct(F.when(x["f"], x["c"]).otherwise(text).alias("text"), F.coalesce(x["f"], F.lit(False)).alias("applied")))


def hint(rules: Mapping[str, str]) -> str:
    """A pattern of the phrases' first words; a text without a match needs no replacement."""
    heads = {k.split()[0] for k in rules if k.split()}
    return "(?i)" + "|".join(T.literal(h) for h in sorted(heads, key=lambda x: (-len(x), x))) if heads else "$^"


# --- tables of phrases

#: Most phrases of a table, and characters in all of them: a task holds the table in some ten times as many bytes.
MOST_PHRASES, MOST_CHARS = 1_000_000, 64_000_000
#: A word, or one other character; phrases and texts are compared unit by unit.
UNIT = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]"


class Trie:
    """Phrases as paths of units in flat arrays: edges are sorted by state and unit, so one search moves many places on.

    unit is the number of each known unit, key and to are the edges (state * units + unit, next state), phrase is the
    number of the phrase that ends at a state, or -1."""

    def __init__(self, phrases: list[str]):
        split = regex.compile(UNIT, regex.DOTALL).findall
        paths = [split(p.lower()) for p in phrases]
        self.unit = {u: i for i, u in enumerate(sorted({u for p in paths for u in p}))}
        n, edges, ends, states = max(1, len(self.unit)), {}, {}, 1
        for number, path in enumerate(paths):
            at = 0
            for u in path:
                edge = at * n + self.unit[u]
                if (to := edges.get(edge)) is None:
                    to = edges[edge] = states
                    states += 1
                at = to
            if path:
                ends.setdefault(at, number)
        self.units, self.key = n, np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.key.tolist()], np.int64)
        self.phrase = np.full(states, -1, np.int64)
        self.phrase[list(ends)] = list(ends.values())

    def longest(self, units: np.ndarray, left: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of units of the longest phrase that begins there, 0 if none does, and the phrase.

        units holds numbers of units (-1: unknown), left how many units are left in each place's text, begins and ends where
        a phrase may. Every place walks on as long as it has a way, all places together."""
        size, found = np.zeros(len(units), np.int64), np.full(len(units), -1, np.int64)
        place, step = np.flatnonzero((units >= 0) & begins), 0
        state = np.zeros(len(place), np.int64)
        while len(place) and len(self.key):
            want = state * self.units + units[place + step]
            edge = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            on = self.key[edge] == want
            place, state, step = place[on], self.to[edge[on]], step + 1
            phrase = self.phrase[state]
            whole = (phrase >= 0) & ends[place + step - 1]
            size[place[whole]], found[place[whole]] = step, phrase[whole]
            on = (left[place] > step) & (units[np.minimum(place + step, len(units) - 1)] >= 0)
            place, state = place[on], state[on]
        return size, found


def _as_found(found: str, new: str) -> str:
    """new in the case of what it stands for, by the rule of in_case_of."""
    if new != new.lower():
        return new
    if found == found.upper() != found.lower():
        return new.upper()
    return new[:1].upper() + new[1:] if found != found.lower() and found[:1] == found[:1].upper() and found[1:] == found[1:].lower() else new


def replaced_by_table(docs: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text and n_replaced of docs, with the phrases of a table (phrase, canonical) by their canonical forms.

    Phrases are found in any case, as whole words: no letter, digit or underscore may touch their ends. The leftmost goes
    first, of those that begin together the longest, and none overlaps one taken. The case of what was found is kept
    as in_case_of says. White space around a phrase doesn't count, empty and null phrases are left out, of phrases equal
    but for case the one with the smallest canonical form holds; a null canonical form removes. Null texts stay null with 0
    replaced. The table goes to the tasks once; more than MOST_PHRASES phrases or MOST_CHARS characters are
    an error. Texts are read where they lie, without a shuffle."""
    clean = phrases.select(F.lower(F.trim("phrase")).alias("p"), F.coalesce("canonical", F.lit("")).alias("c")).where("length(p) > 0").groupBy("p").agg(F.min("c").alias("c"))
    n, chars = clean.agg(F.count("*"), F.coalesce(F.sum(F.length("p") + F.length("c")), F.lit(0))).first()
    if n > MOST_PHRASES or chars > MOST_CHARS:
        raise ValueError(f"{n} phrases of {chars} characters: at most {MOST_PHRASES} and {MOST_CHARS} are held in a task")
    table = clean.orderBy("p").toArrow()
    names, forms = table["p"].to_pylist(), table["c"].to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast((Trie(names), forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, canonical = shared.value
        split, wordy = regex.compile(UNIT, regex.DOTALL).findall, regex.compile(r"[\p{L}\p{M}\p{N}_]").match
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [split(t) if t else [] for t in texts]
            length = np.array([len(p) for p in parts], np.int64)
            end = np.cumsum(length)
            units = np.fromiter((trie.unit.get(u.lower(), -1) for p in parts for u in p), np.int64, int(end[-1]) if len(end) else 0)
            left = np.repeat(end, length) - np.arange(len(units))
            letters = np.fromiter((wordy(u) is not None for p in parts for u in p), bool, len(units))
            # a phrase that begins or ends with another character than a letter may not touch one there
            fresh = np.concatenate(([True], left[:-1] == 1)) if len(units) else letters
            begins = letters | fresh | ~np.concatenate(([False], letters[:-1]))[: len(units)]
            ends = letters | (left == 1) | ~np.concatenate((letters[1:], [False]))[: len(units)]
            size, found = trie.longest(units, left, begins, ends)
            begin = np.flatnonzero(size)
            row = np.searchsorted(end, begin, "right")
            counts = [0] * len(texts)
            for places in np.split(begin, np.flatnonzero(np.diff(row)) + 1) if len(begin) else []:
                i = int(np.searchsorted(end, places[0], "right"))
                own, base, out, upto = parts[i], int(end[i] - length[i]), [], 0
                for place in places.tolist():
                    a, b = place - base, place - base + int(size[place])
                    if a < upto:
                        continue
                    out += own[upto:a]
                    out.append(_as_found("".join(own[a:b]), canonical[found[place]]))
                    upto = b
                    counts[i] += 1
                texts[i] = "".join(out + own[upto:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [key, "text", "n_replaced"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, text string, n_replaced bigint")
