"""Macros: phrases learned over a whole collection, and their use in the texts that get shorter by them.

Learning goes in rounds. In each, neighbouring words are counted over all texts, the pairs that save most become
one word, and the next round counts with it; so phrases grow as long as that pays. A text then
names its own phrases in a legend and has their aliases in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A letter that joins the words of a learned phrase; a text that has it is left alone.
JOINT = "ꞏ"
#: Most macros of a text, least words and uses, and the share of tokens that must be saved; how a legend begins.
MOST, WORDS, USES, SAVED, LEGEND = 4, 3, 2, 0.015, "Macros:"
#: Pairs that become words in a round; least uses of one in the collection.
PAIRS, COMMON = 16, 3
#: What parts runs of words with one space between them. (A repeated group would go as deep into the stack as a run has words.)
_APART = rf"[^ \p{{L}}\p{{M}}\p{{N}}{JOINT}]+| {{2,}}"


def pair_counts(texts: Column, docs: DataFrame) -> DataFrame:
    """a, b, n and saved: pairs of different words with one space between them, and the characters that all uses but one have."""
    words = docs.select(F.explode(F.split(texts, _APART)).alias("run")).select(F.split(F.btrim("run"), " ").alias("w")).where("size(w) > 1")
    pairs = words.select(F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(w[i] as a, w[i + 1] as b))")).alias("p")).select("p.*").where("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return counted.withColumn("saved", (F.col("n") - 1) * (F.length("a") + F.length("b") + 1))


def best_pairs(counts: DataFrame, most: int = PAIRS) -> list[tuple[str, str]]:
    """The pairs that save most, ties in order of their words, of which no word is in two."""
    out, used = [], set()
    # a word bars others from its pair, so a few more are looked at than are taken
    for row in counts.orderBy(F.desc("saved"), "a", "b").limit(8 * most).collect():
        if row.a not in used and row.b not in used and len(out) < most:
            used |= {row.a, row.b}
            out.append((row.a, row.b))
    return out


def _merged(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The pairs as one word each: no word of one is in another, so no match hides another."""
    letter, either = rf"[\p{{L}}\p{{M}}\p{{N}}{JOINT}]", "|".join(f"{a} {b}" for a, b in pairs)
    return T.replaced(text, f"(?<!{letter})(?:{either})(?!{letter})", lambda m: F.replace(m, F.lit(" "), F.lit(JOINT)))


def learned(docs: DataFrame, rounds: int = 4, pairs: int = PAIRS) -> tuple[DataFrame, list[list[tuple[str, str]]]]:
    """docs with learned phrases as single words, and the pairs of each round.

    Counts are summed in the tasks first, so a pair may have any share of all uses. The driver sees 8 times the pairs of a round.
    Learning ends early where no pair is left."""
    history: list[list[tuple[str, str]]] = []
    clean = docs.withColumn("text", F.when(F.contains(F.col("text"), F.lit(JOINT)), None).otherwise(F.col("text")))
    for _ in range(rounds):
        if not (found := best_pairs(pair_counts(F.col("text"), clean), pairs)):
            break
        history.append(found)
        clean = clean.withColumn("text", _merged(F.col("text"), found))
    return clean, history


def with_macros(docs: DataFrame, rounds: int = 4, key: str = "doc_id") -> DataFrame:
    """key, text, legend (aliases and phrases, in order) and saved (tokens): texts with their macros, where that has fewer tokens.

    Of the phrases learned over all docs, a text takes the up to MOST that save it most, of WORDS words and USES uses or more,
    if each use of an alias counts as a word and the legend's line as its words; the text stays as it is, with an
    empty legend, if less than SAVED of its tokens would go, if it has a bracketed letter or the
    legend's word already, or if it is null. Saving is never negative; restored() gives the text back."""
    merged, _ = learned(docs.select(key, "text", F.col("text").alias("original")), rounds)
    phrase = rf"[\p{{L}}\p{{M}}\p{{N}}]+(?:{JOINT}[\p{{L}}\p{{M}}\p{{N}}]+){{{WORDS - 1},}}"
    uses = F.regexp_extract_all("text", F.lit(phrase), F.lit(0))
    size = lambda p: F.size(F.split(p, JOINT))
    counted = F.transform(F.array_distinct(uses), lambda p: F.struct(F.size(F.filter(uses, lambda u: u == p)).alias("n"), p.alias("p")))
    worth = F.filter(F.transform(counted, lambda c: F.struct((-(c["n"] * (size(c["p"]) - 1) - size(c["p"]) - 1)).alias("less"), c["p"].alias("p"), c["n"].alias("n"))), lambda c: (c["n"] >= USES) & (c["less"] < 0))
    chosen = F.slice(F.array_sort(worth), 1, MOST)
    rows = merged.select(key, "original", F.col("text").alias("joined"), F.coalesce(chosen, F.array().cast("array<struct<less:int,p:string,n:int>>")).alias("c"))
    letters = F.array(*[F.lit(f"[{x}]") for x in "ABCDEFGHIJKLMNOP"[:MOST]])
    rows = rows.withColumn("legend", F.transform("c", lambda c, i: F.struct(F.get(letters, i).alias("alias"), F.replace(c["p"], F.lit(JOINT), F.lit(" ")).alias("phrase"))))
    # whole words alone are replaced: a phrase's letters may not go on
    table = F.map_from_arrays(F.transform("c", lambda c: c["p"]), F.transform("legend", lambda x: x["alias"]))
    body = T.replaced(F.col("joined"), phrase, lambda m: F.coalesce(F.try_element_at(table, m), m))
    line = F.concat(F.lit(f"{LEGEND} "), F.array_join(F.transform("legend", lambda x: F.concat(x["alias"], F.lit("="), x["phrase"])), "; "), F.lit("\n"))
    made = F.concat(line, F.replace(body, F.lit(JOINT), F.lit(" ")))
    rows = rows.withColumn("made", F.when((F.size("c") > 0) & ~F.col("original").rlike(rf"\[[A-P]\]|{LEGEND}"), made)).withColumn("saved", (T.n_tokens(F.col("original")) - T.n_tokens(F.col("made"))).cast("long"))
    good = F.coalesce(F.col("made").isNotNull() & (F.col("saved") > 0) & (F.col("saved") >= SAVED * T.n_tokens(F.col("original"))), F.lit(False))
    return rows.select(key, F.when(good, F.col("made")).otherwise(F.col("original")).alias("text"), F.when(good, F.col("legend")).otherwise(F.array().cast("array<struct<alias:string,phrase:string>>")).alias("legend"), F.when(good, F.col("saved")).otherwise(0).cast("long").alias("saved"))


def restored(text: Column, legend: Column) -> Column:
    """The text before macros: without the legend's line, and phrases for aliases."""
    body = F.substring(text, F.instr(text, F.lit("\n")) + 1, F.length(text))
    return F.when(F.size(legend) > 0, F.aggregate(legend, body, lambda t, x: F.replace(t, x["alias"], x["phrase"]))).otherwise(text)
