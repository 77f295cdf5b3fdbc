"""Spelling variants: words one edit apart, by forward and backward minimal automata.

Two words at most one edit apart agree in the first half of either, or in the last half. So
each word is looked up twice in minimal acyclic automata of the vocabulary: its first half
is walked exactly from the front and the rest completed with one error, and the
same with reversed words from the back. The automata number their words, so what is found is a
number, and a pair that both ways would give is left to the forward one.

Words are dealt out by length and half, as what is looked up by a half lies in one part;
each task builds the automaton of one part of bounded size. A half that more words share
is dealt out by blocks of its words against blocks of its lookups.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc32_sql, release, table

#: Runs of letters, their least length, the share of runs that lose a letter, and the least count of a word.
RUN, LEAST, ONE_IN, COUNT = r"[A-Za-zÀ-ÿ]{5,}", 5, 97, 3
#: Most words of an automaton, and lookups of a task beside it.
PART = 40_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Minimal acyclic automaton of sorted distinct words that numbers them in their order.

    edges[state] maps a character to the next state and to how many words of the state come before;
    counts[state] is how many words it has, final[state] whether the empty one is among them."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.counts: list[int] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        open_: list[list] = [[False, {}, ""]]  # states on the way of the last word: final, edges, the letter to the next
        last = ""
        for word in words:
            same = len(os.path.commonprefix((last, word)))
            self._close(open_, same)
            for c in word[same:]:
                open_[-1][2] = c
                open_.append([False, {}, ""])
            open_[-1][0] = True
            last = word
        self._close(open_, 0)
        self.start = self._state(open_[0])
        del self._known

    def _close(self, open_: list[list], depth: int) -> None:
        while len(open_) > depth + 1:
            state = self._state(open_.pop())
            open_[-1][1][open_[-1][2]] = state

    def _state(self, node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if (state := self._known.get(key)) is None:
            state = self._known[key] = len(self.edges)
            before, edges = int(node[0]), {}
            for c, to in node[1].items():
                edges[c] = (to, before)
                before += self.counts[to]
            self.edges.append(edges)
            self.counts.append(before)
            self.final.append(node[0])
        return state

    def walk(self, word: str, state: int, number: int) -> tuple[int, int]:
        """State and number after exactly this word, -1 if there is no way."""
        edges = self.edges
        for c in word:
            if (step := edges[state].get(c)) is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, half: int, change: int) -> list[int]:
        """Numbers of the words that begin with the first half letters of word and differ from it by one
        letter after them: inserted (change 1), replaced (0) or deleted (-1); each once."""
        state, number = self.walk(word[:half], self.start, 0)
        found: list[int] = []
        edges, final, walk = self.edges, self.final, self.walk
        for i in range(half, len(word) + (change == 1)):
            if state < 0:
                break
            last = word[i - 1] if i > half else ""
            if change < 0:
                if word[i] != last:  # of equal letters in a row any one is the same
                    ways = [(state, number)]
                else:
                    ways = []
            else:
                but = last if change else word[i]
                ways = [(to, number + n) for c, (to, n) in edges[state].items() if c != but]
            rest = word[i:] if change > 0 else word[i + 1 :]
            for to, n in ways:
                to, n = walk(rest, to, n)
                if to >= 0 and final[to]:
                    found.append(n)
            if i < len(word):
                step = edges[state].get(word[i])
                state, number = (step[0], number + step[1]) if step else (-1, 0)
        return found


def looked_up(words: list[str], asked: list[str], half: list[int], change: list[int], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in asked and in words (sorted) of the pairs that one direction finds; backward leaves out those
    that share the first half too."""
    turned = sorted((w[::-1], i) for i, w in enumerate(words)) if backward else [(w, i) for i, w in enumerate(words)]
    automaton, order = Automaton([w for w, _ in turned]), [i for _, i in turned]
    left: list[int] = []
    right: list[int] = []
    for k, (word, h, c) in enumerate(zip(asked, half, change)):
        if backward:
            numbers = [order[n] for n in automaton.near(word[::-1], len(word) - h, c)]
            numbers = [n for n in numbers if words[n][:h] != word[:h]]
        else:
            numbers = automaton.near(word, h, c)
        left += [k] * len(numbers)
        right += numbers
    return np.array(left, np.int64), np.array(right, np.int64)


def _dealt(words: DataFrame, n: int) -> DataFrame:
    """Each word in its part of either direction, and its lookups in theirs: part, word, n, change (null: an entry)."""
    half = F.expr("cast(length(word) div 2 as int)")

    def key(size: Column, length: Column, backward: bool) -> Column:
        return F.struct(F.lit(backward).alias("backward"), length.alias("length"), F.when(F.lit(backward), F.expr("reverse(word)")).otherwise(F.col("word")).substr(F.lit(1), size).alias("half"))

    share = lambda length: F.greatest(F.lit(2), F.floor((length - 1) / 2).cast("int"))
    rows = words.select("word", "n", F.length("word").alias("size"))
    ways = []
    for backward in (False, True):
        ways.append(F.struct(key(share(F.col("size")), F.col("size"), backward).alias("key"), F.lit(None).cast("int").alias("change")))
        for change in (-1, 0, 1):
            length = F.col("size") + change
            ways.append(F.struct(key(share(length), length, backward).alias("key"), F.lit(change).alias("change")))
    each = rows.select("word", "n", F.explode(F.array(*ways)).alias("x")).select("word", "n", "x.key", "x.change").where(f"key.length >= {LEAST}")
    parts = max(1, -(-n // (PART // 2)), min(4 * words.sparkSession.sparkContext.defaultParallelism, -(-n // 500)))
    hot = checkpoint(each.where("change is null").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > PART // 2).select("key", F.ceil(F.col("c") / (PART // 2)).cast("int").alias("blocks")))
    if not hot.isEmpty():
        # entries of such a half meet its lookups by blocks of both
        each = each.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.expr("pmod(xxhash64(word, 7), blocks)").cast("int")
        other = F.explode(F.expr("sequence(0, blocks - 1)"))
        each = each.select("*", own.alias("own"), other.alias("other")).withColumn("block", F.when(F.col("change").isNull(), F.struct(F.col("own").alias("a"), F.col("other").alias("b"))).otherwise(F.struct(F.col("other").alias("a"), F.col("own").alias("b"))))
    else:
        each = each.withColumn("block", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    part = F.when((F.col("block.a") == 0) & (F.col("block.b") == 0), F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.xxhash64("key", "block"))
    return each.select(F.col("key.backward").alias("backward"), part.alias("part"), "word", "n", "change", half.alias("half"))


def _found(words: DataFrame, n: int, pairs: bool) -> DataFrame:
    """word, near and near_n of each pair, or per word and part their number and the near word of largest n."""
    schema = "word string, near string, near_n bigint" if pairs else "word string, n_near bigint, near string, near_n bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        entry, ask = rows.filter(pc.is_null(rows["change"])), rows.filter(pc.is_valid(rows["change"]))
        known, many, asked = entry["word"].to_pylist(), entry["n"].to_numpy(), ask["word"].to_pylist()
        left, right = looked_up(known, asked, ask["half"].to_pylist(), ask["change"].to_pylist(), key[0].as_py())
        words_of, others = np.array(asked, object), np.array(known, object)
        if pairs:
            columns = [words_of[left], others[right], many[right]]
        else:
            # per lookup the number, and the first in order of count and then of code points
            by = np.lexsort((right, -many[right], left))
            at, start, count = np.unique(left[by], return_index=True, return_counts=True)
            best = right[by][start]
            columns = [words_of[at], count, others[best], many[best]]
        kinds = {"word": pa.string(), "near": pa.string()}
        out = pa.Table.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, columns)], names)
        release()
        return out

    return _dealt(words, n).groupBy("backward", "part").applyInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n: all ordered pairs of words(word, n) that are one inserted, deleted or replaced code point apart."""
    return _found(words, words.count(), True)


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of words(word, n), a checkpointed table of distinct words of LEAST code points or more.

    form is the near word of largest n (ties: the smallest in code-point order), if its n is at least twice the word's;
    root is where forms lead. n at least doubles with each form, so ways are short, and each round doubles
    what they leap."""
    sums = _found(words, words.count(), False).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(sums, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("m"))
    takes = F.col("m") >= 2 * F.col("n")
    rows = checkpoint(rows.select("word", F.when(takes, F.col("near")).alias("form"), "n", "n_near", F.when(takes, F.col("m")).alias("form_n")))
    up = checkpoint(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = up.join(up.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = checkpoint(further)
        up = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words of docs: runs of at least LEAST letters, A-Z in lower case, some with a letter less, at
    least COUNT times in all; checkpointed.

    A run loses the letter h % length, h being the crc32 of "<doc_id>:<run>", if ONE_IN divides h. Null texts have no
    words; with a null doc_id no run loses a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % ONE_IN == 0, less).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LEAST)
    return checkpoint(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT))


def variants(docs: DataFrame) -> DataFrame:
    """Words of docs with their forms, as vocabulary() and grouped() say.

    Equal rows count each; a table without such words gives no rows; other columns are left out. Words are counted
    before they are shuffled, so a word may have any share of all runs."""
    return grouped(vocabulary(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')), '{_UPPER}', '{_LOWER}') run FROM documents),
c AS (SELECT run, k, count(*) c, any_value({crc32_sql("k")}) h FROM (SELECT run, doc_id || ':' || run k FROM o) GROUP BY 1, 2),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, c FROM c),
v AS (SELECT word, CAST(sum(c) AS BIGINT) n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM v),
s AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) less, substr(word, 1, i - 1) || '_' || substr(word, i + 1) mask FROM i),
p AS (SELECT a.word, b.word near, b.n m FROM s a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM s a JOIN v b ON a.less = b.word UNION SELECT a.word, b.word, b.n FROM s a JOIN s b ON a.mask = b.mask AND a.word <> b.word),
b AS (SELECT word, count(*) n_near, max(m) m FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) n_near, b.m form_n, (SELECT min(near) FROM p WHERE p.word = b.word AND p.m = b.m) form FROM v LEFT JOIN b ON v.word = b.word AND TRUE),
g AS (SELECT word, n, n_near, CASE WHEN form_n >= 2 * n THEN form END form, CASE WHEN form_n >= 2 * n THEN form_n END form_n FROM f),
r AS (SELECT word, word AS at, form AS next FROM g UNION ALL SELECT r.word, g.word, g.form FROM r JOIN g ON g.word = r.next)
SELECT g.word, form, r.at AS root, n, n_near, form_n FROM g JOIN r ON r.word = g.word AND r.next IS NULL
"""
