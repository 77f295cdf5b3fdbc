"""What a rewrite has to leave alone and to keep: forced spans, and fingerprints of constraints."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .phrases import PLACEHOLDER

#: A token with a digit.
DIGITS = r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*"


def spans(docs: DataFrame, patterns: Mapping[str, str], key: str = "doc_id") -> DataFrame:
    """key, name, start, end and value of every match of the named patterns; empty matches and placeholders are none.

    Offsets are running sums of what lies between and in the matches, a pattern by itself."""
    rows = None
    for name, pattern in patterns.items():
        found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern)
        zipped = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap")))
        one = docs.where(F.col("text").rlike(pattern)).select(key, F.lit(name).alias("name"), F.posexplode(zipped).alias("i", "x")).where("x.value is not null")
        rows = one if rows is None else rows.union(one)
    upto = F.expr(f"sum(x.gap + length(x.value)) over (partition by {key}, name order by i)")
    rows = rows.select(key, "name", upto.alias("end"), "x.value").select(key, "name", (F.col("end") - F.length("value")).alias("start"), "end", "value")
    return rows.where((F.col("end") > F.col("start")) & ~F.col("value").rlike(f"^{PLACEHOLDER}$"))


def longest_apart(rows: DataFrame, order: Mapping[str, int], key: str = "doc_id") -> DataFrame:
    """The spans (key, name, start, end, value) that are taken from left to right: of those that begin together the longest, then
    the one of the smaller order of its name; one that begins inside one taken isn't.

    A text's spans meet in one row, in order; a text is one row itself."""
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("name"))
    one = F.struct("start", (F.col("start") - F.col("end")).alias("less"), place.alias("place"), "name", "end", "value")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at, taken, upto = batch.column(1).flatten(), 0, [], 0
            parent = pc.list_parent_indices(batch.column(1)).to_pylist()
            last = None
            for i, (row, start, end) in enumerate(zip(parent, flat.field("start").to_pylist(), flat.field("end").to_pylist())):
                if row != last:
                    last, upto = row, 0
                if start >= upto:
                    taken.append(i)
                    upto = end
            rows_of = pa.array([parent[i] for i in taken], pa.int64())
            kept = flat.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_of), *(kept.field(c) for c in ("name", "start", "end", "value"))], [key, "name", "start", "end", "value"])

    return lists.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, name string, start bigint, end bigint, value string")


def forced_spans(docs: DataFrame, patterns: Mapping[str, str], digits: bool = True, key: str = "doc_id") -> DataFrame:
    """key, name, start, end and value of what must stay as it is: matches of the caller's patterns (name to regular
    expression, the order of the mapping decides ties) and, if asked, tokens with a digit (name `digits`).

    Null texts and texts without a match have no rows; keys have to be different for different texts. No pattern at
    all is an error, as is one that matches nothing but the empty text everywhere."""
    named = dict(patterns) | ({"digits": DIGITS} if digits else {})
    if not named:
        raise ValueError("no pattern")
    return longest_apart(spans(docs, named, key), {n: i for i, n in enumerate(named)}, key)


# --- fingerprints

#: Terms that negate, words that aren't anchors, and what makes a segment a constraint of a kind.
NEGATIONS = ["can't", "cannot", "do not", "don't", "must not", "never", "no", "not", "should not", "without"]
STOPWORDS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "our", "that", "the", "to", "we", "with", "you", "your"]
MUST = ["must", "required to", "need to", "has to", "shall"]
SHOULD = ["should", "recommended to", "ought to"]
DO_NOT = ["do not", "don't", "must not", "should not", "never", "cannot", "can't"]
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
QUOTED = r'"[^"]{2,160}"|' + r"'[^']{2,160}'|`[^`]{2,160}`"
#: Anchors a constraint has, those looked for, and how far from one a negation may stand.
ANCHORS, LOOKED_FOR, NEAR = 8, 4, 80


def whole(terms: list[str]) -> str:
    """Any of the terms between characters that aren't letters, digits or underscores, of any script."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"(?:^|{edge})(?:{'|'.join(terms)})(?:$|{edge})"


def _anchors(segment: Column) -> Column:
    words = F.regexp_extract_all(segment, F.lit("[a-z0-9]+"), F.lit(0))
    skip = F.array(*map(F.lit, sorted({*STOPWORDS, *NEGATIONS})))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(skip, w)), 1, ANCHORS)


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, said, anchors and numbers: each constraint of a text.

    Sentences and lines are segments, in lower case with single spaces. One with a negation is a `negation`, with a digit a
    `numeric`, with an obligation a `must`, else with a recommendation a `should`, with a ban a `do_not`; a segment may be several. Quoted
    texts of 2 to 160 characters are `quoted`, each once. Null and empty texts have none. A segment is looked at by itself."""
    segment = docs.select(key, F.explode(F.transform(T.sentences(F.col("text")), T.squeezed)).alias("said")).where("length(said) > 0")
    has = lambda pattern: F.col("said").rlike(pattern)
    tests = {"negation": has(whole(NEGATIONS)), "numeric": has("[0-9]"), "must": has(whole(MUST)), "should": has(whole(SHOULD)) & ~has(whole(MUST)), "do_not": has(whole(DO_NOT))}
    kinds = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda k: k.isNotNull())
    rows = segment.select(key, F.explode(kinds).alias("kind"), "said", _anchors(F.col("said")).alias("anchors"), F.when(has("[0-9]"), F.regexp_extract_all("said", F.lit(NUMBER), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("numbers"))
    quoted = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(0))).alias("q")).select(key, F.lit("quoted").alias("kind"), T.squeezed(F.expr("substring(q, 2, length(q) - 2)")).alias("said")).where("length(said) > 0")
    none = F.array().cast("array<string>")
    return rows.union(quoted.distinct().select(key, "kind", "said", none, none))


def violations(constraints: DataFrame, rewrites: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, severity, said and reason of each constraint that a rewrite (key, text) doesn't keep.

    A quoted text has to stand in it; all numbers of a numeric constraint and one of its first four anchors; one anchor of a
    `must` or `should` one; of a negation or ban, an anchor with a negating term within 80 characters before or
    after its first place, or, without anchors, any negating term. `should` is advisory, the rest mandatory. Keys without a
    rewrite have no row; a null rewrite keeps nothing."""
    rows = constraints.join(rewrites.select(key, T.squeezed(F.coalesce("text", F.lit(""))).alias("now")), key)
    looked = F.slice("anchors", 1, LOOKED_FOR)
    stands = (F.size(looked) == 0) | F.exists(looked, lambda a: F.contains(F.col("now"), a))
    around = lambda a: F.substring("now", F.greatest(F.instr(F.col("now"), a) - NEAR, F.lit(1)), F.least(F.instr(F.col("now"), a) - 1, F.lit(NEAR)) + NEAR)
    negated = F.when(F.size(looked) == 0, F.col("now").rlike(whole(NEGATIONS))).otherwise(F.exists(looked, lambda a: F.contains(F.col("now"), a) & around(a).rlike(whole(NEGATIONS))))
    kept = (
        F.when(F.col("kind") == "quoted", F.contains(F.col("now"), F.col("said")))
        .when(F.col("kind") == "numeric", F.forall("numbers", lambda n: F.contains(F.col("now"), n)) & stands)
        .when(F.col("kind").isin("must", "should"), stands).otherwise(negated)
    )
    reasons = {"quoted": "missing_literal", "numeric": "missing_or_changed_numeric_constraint", "must": "missing_must_directive", "should": "missing_should_directive", "negation": "polarity_violation", "do_not": "polarity_violation"}
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), F.col("kind"))
    return rows.where(~kept).select(key, "kind", F.when(F.col("kind") == "should", "advisory").otherwise("mandatory").alias("severity"), "said", reason.alias("reason"))
