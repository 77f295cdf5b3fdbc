"""Short names for what recurs in a text, with a legend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: What is looked for, its alias, the fewest uses, the shortest match and the most aliases.
KINDS = {
    "reference": (r"https?://[^ \t\n\"<>)]+", "R", 2, 12, 8),
    "label": (r"(?m)^[A-Z][A-Za-z]{3,30}(?=:)", "L", 2, 4, 8),
    "entity": (r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", "E", 3, 12, 6),
    "parenthetical": (r"\([^()\n]{6,80}\)", "P", 2, 8, 6),
}


def counts(found: Column) -> Column:
    """value and n of each distinct value of an array, in the order of the values; n log n in its length."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return T.let(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("value"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("n"))))

    return T.let(F.array_sort(found), runs)


def chosen(text: Column, pattern: str, uses: int, chars: int, most: int) -> Column:
    """The matches worth an alias: those used so often and so long, the most characters saved first."""
    good = F.filter(counts(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda x: (x["n"] >= uses) & (F.length(x["value"]) >= chars))
    ranked = F.array_sort(F.transform(good, lambda x: F.struct((-(x["n"] - 1) * F.length(x["value"])).alias("saved"), x["value"].alias("value"))))
    return F.slice(F.transform(ranked, lambda x: x["value"]), 1, most)


def aliased(text: Column, kind: str) -> Column:
    """text and legend (value by alias, null if none): recurring matches of a kind by aliases, where the text
    with its legend has fewer tokens or, of as many, fewer characters."""
    pattern, prefix, uses, chars, most = KINDS[kind]

    def made(top: Column) -> Column:
        name = lambda m: F.concat(F.lit(prefix), F.array_position(top, m).cast("string"))
        body = T.replaced(text, pattern, lambda m: F.when(F.array_position(top, m) > 0, name(m)).otherwise(m))
        legend = F.transform(top, lambda m: F.concat(name(m), F.lit("="), m))
        whole = F.concat(body, F.lit("\nLegend: "), F.array_join(legend, "; "))
        less = (T.n_tokens(whole) < T.n_tokens(text)) | ((T.n_tokens(whole) == T.n_tokens(text)) & (F.length(whole) < F.length(text)))
        use = (F.size(top) > 0) & less
        return F.struct(F.when(use, body).otherwise(text).alias("text"), F.when(use, legend).alias("legend"))

    return T.let(chosen(text, pattern, uses, chars, most), made)


def with_legend(text: Column, *legends: Column) -> Column:
    """The text and one line that names all entries, if there are any."""
    entries = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in legends]))
    return T.let(entries, lambda e: F.when(F.size(e) > 0, F.concat(text, F.lit("\nLegend: "), F.array_join(e, "; "))).otherwise(text))


def restored(text: Column, legend: Column) -> Column:
    """The text with every alias of the legend replaced by its value."""
    keys = F.transform(legend, lambda x: F.regexp_extract(x, "^([A-Z][0-9]+)=", 1))
    values = F.transform(legend, lambda x: F.regexp_replace(x, "^[A-Z][0-9]+=", ""))
    back = lambda b: T.replaced(text, r"\b[A-Z][0-9]+\b", lambda m: F.coalesce(F.get(b["v"], F.array_position(b["k"], m).cast("int") - 1), m))
    return F.when(legend.isNull(), text).otherwise(T.let(F.struct(keys.alias("k"), values.alias("v")), back))
