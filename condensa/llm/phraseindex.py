"""Benchmark decontamination by a distributed positional inverted index.

Training texts are stored as postings (term, document, position) of the terms that tests
are looked up by. A test's exact phrases are its runs of SIZE words, one shorter run if
it has fewer. Each phrase is looked up by its two rarest words: their posting lists, each
less the word's offset, are intersected, and what is in both lists is compared with the
phrase word by word. Proximity is found from a test's rarest word outwards.

DataFrame functions only. Texts never travel: only postings of looked-up terms do, and the
stretches around candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

SIZE = 10
#: Words of a stretch of a document that candidates are compared in.
STRETCH = 64
#: Most rows that are broadcast; beyond, both sides of a join are shuffled. Rows have at most a few hundred bytes.
SMALL = 50_000
#: A word is a run of ASCII letters, digits and all code points from 0x80 on. Java tests a class of ranges range
#: by range for each character, several times as long as its classes of ASCII characters take.
WORD = r"[\p{Alnum}[^\x00-\x7F]]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters between words.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: What names a document: its id and a digest of its text, as rows of one id may differ.
DOC = ["id", "digest"]


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    apart = F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.coalesce(F.array_remove(F.split(apart, " "), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """How many words(text) has; counting needs no lower case."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(rows: DataFrame) -> DataFrame:
    """rows, a checkpointed table, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def named(docs: DataFrame) -> DataFrame:
    """id (null as the least long), digest and text of documents."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("digest"), "text")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, id, digest and pos (from 0) of each word of docs that is in terms(term), a checkpointed table."""
    each = named(docs).select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return each.join(small(terms), "term").select("term", *DOC, "pos")


def tests_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tests(test, w), the distinct word lists of items with words, and members(test, item_id as string), both checkpointed."""
    each = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    tests = checkpoint(each.select("w").distinct().withColumn("test", F.monotonically_increasing_id()))
    return tests, checkpoint(each.where("item_id is not null").join(tests, "w").select("test", "item_id").distinct())


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n, how often docs have it, for those of terms that they have at all; checkpointed."""
    each = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return checkpoint(each.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n")))


def _rarest(tests: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Runs of phrases looked up by the same two words: test, w, k (words of a phrase), low and high (first words of
    the first and last phrase), p and q (places of its rarest word and the next) and their terms a and b."""
    each = tests.select("test", F.posexplode("w").alias("pos", "term"))
    n = frequencies(docs, checkpoint(each.select("term").distinct()))
    # a word that documents don't have is null: its phrases can't occur
    ranks = each.join(n, "term", "left").groupBy("test").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("r"))
    rows = tests.join(ranks, "test").withColumn("k", F.least(F.size("w"), F.lit(size)))
    first = F.explode(F.expr("filter(transform(sequence(0, size(w) - k), s -> struct(s, slice(r, s + 1, k) as r)), x -> forall(x.r, y -> y.n is not null))"))
    rows = rows.select("test", "w", "k", first.alias("x")).withColumn("o", F.expr("array_sort(transform(x.r, y -> struct(y.n, y.pos)))"))
    rows = rows.select("test", "w", "k", F.col("x.s").alias("s"), F.expr("o[0].pos").alias("p"), F.expr("if(k > 1, get(o, 1).pos, o[0].pos)").alias("q"))
    return rows.groupBy("test", "p", "q").agg(F.first("w").alias("w"), F.first("k").alias("k"), F.min("s").alias("low"), F.max("s").alias("high")).selectExpr("*", "w[p] as a", "w[q] as b")


def stretches(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """id, digest, b, base and d: the words d from place base on around stretch b of the documents in found, a
    checkpointed table of documents that have words. Spark would move a filter on words below the join, and cut the
    texts of all documents for it, so there is none."""
    texts = named(docs).join(small(found), DOC, "left_semi").distinct()
    cut = F.expr(f"transform(sequence(0, (size(w) - 1) div {STRETCH}), b -> struct(b as b, greatest(0, b * {STRETCH} - {size - 1}) as base, slice(w, greatest(0, b * {STRETCH} - {size - 1}) + 1, {STRETCH + 2 * (size - 1)}) as d))")
    return texts.select(*DOC, words(F.col("text")).alias("w")).select(*DOC, F.inline(cut))


def phrase_matches(docs: DataFrame, tests: DataFrame, size: int = SIZE) -> DataFrame:
    """id, digest, test, first and end: stretches of documents that phrases of a test cover, each of one run of phrases.

    tests(test, w) are word lists. Phrases with equal two rarest words and places are neighbours,
    so what matches of them at one place is one stretch."""
    look = checkpoint(_rarest(tests, docs, size).withColumn("run", F.monotonically_increasing_id()))
    index = checkpoint(postings(docs, checkpoint(look.selectExpr("explode(array(a, b)) as term").distinct())))

    def shifted(term: str, place: str) -> DataFrame:
        lists = small(look.select(F.col(term).alias("term"), "run", F.col(place).alias("place")))
        return index.join(lists, "term").select("run", *DOC, (F.col("pos") - F.col("place")).alias("at"))

    both = checkpoint(shifted("a", "p").join(shifted("b", "q"), ["run", *DOC, "at"], "left_semi"))
    rows = both.join(small(look), "run").withColumn("b", F.expr(f"(at + p) div {STRETCH}").cast("int")).join(stretches(docs, checkpoint(both.select(*DOC).distinct()), size), [*DOC, "b"])
    same = F.expr("filter(sequence(low, high), s -> at + s >= base and slice(d, greatest(1, at + s - base + 1), k) = slice(w, s + 1, k))")
    rows = rows.withColumn("s", same).where("size(s) > 0")
    return rows.select(*DOC, "test", (F.col("at") + F.array_min("s")).alias("first"), (F.col("at") + F.array_max("s") + F.col("k")).alias("end"))


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 20) -> DataFrame:
    """doc_id, item_id (string) and pos: where an item's rarest word stands with each other word of the item at most
    `within` words away, in any order.

    Ids null take no part; an item without words, or with one that documents don't have, gives no row; rows of one
    doc_id with different texts are matched apart. Positions meet by stretches of `within` words, three to a place."""
    tests, members = tests_of(items)
    each = tests.select("test", F.explode(F.array_distinct("w")).alias("term"))
    n = frequencies(docs, checkpoint(each.select("term").distinct()))
    ranked = each.join(n, "term", "left").withColumn("rank", F.expr("row_number() over (partition by test order by n, term)")).withColumn("m", F.expr("count(*) over (partition by test)"))
    ranked = checkpoint(ranked.withColumn("whole", F.expr("min(n is not null) over (partition by test)")).where("whole").select("test", "term", "rank", "m"))
    index = checkpoint(postings(docs.where("doc_id is not null"), checkpoint(ranked.select("term").distinct())).distinct())
    start = index.join(small(ranked.where("rank = 1")), "term").select("test", "m", *DOC, "pos")
    near = start.select("test", "m", *DOC, "pos", F.explode(F.expr(f"sequence(pos div {within} - 1, pos div {within} + 1)")).alias("b")).join(small(ranked.where("rank > 1").select("test", "term")), "test")
    others = index.selectExpr("term", *DOC, "pos as other", f"pos div {within} as b")
    met = near.join(others, ["term", *DOC, "b"]).where(f"abs(other - pos) <= {within}").groupBy("test", "m", *DOC, "pos").agg(F.count_distinct("term").alias("n"))
    whole = met.where("n = m - 1").select("test", *DOC, "pos").union(start.where("m = 1").select("test", *DOC, "pos"))
    return whole.join(small(members), "test").selectExpr("id as doc_id", "item_id", "pos").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs.

    A null or empty text has no words and isn't contaminated. Rows with a null doc_id are matched like
    others; equal rows give equal results, as do different texts under one doc_id each its own. Items with equal
    words are looked up once; a null item_id marks words, but isn't counted or listed. Texts are
    matched whole, however long; either table may be empty; further columns are left out. A phrase or word
    that a third of all documents has gives rows in proportion, dealt by document; a posting
    list meets its phrases where it lies, or in a join that AQE splits. Positions that several
    phrases cover count once."""
    tests, members = tests_of(items)
    found = checkpoint(phrase_matches(docs, tests, size))
    # from left to right, what each stretch adds to those before it
    before = F.expr("coalesce(max(end) over (partition by id, digest order by first, end rows between unbounded preceding and 1 preceding), 0)")
    hit = found.select(*DOC, "first", "end").distinct().withColumn("before", before).groupBy(*DOC).agg(F.sum(F.expr("greatest(0, end - greatest(first, before))")).alias("n_hit"))
    listed = found.select(*DOC, "test").distinct().join(small(members), "test").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marked = hit.join(listed, DOC, "left")
    rows = docs.withColumn("n_words", n_words(F.col("text")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("digest"), "n_words").join(marked, DOC, "left")
    hits, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", hits.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) item_id, {_W.format("text")} w FROM benchmark), t AS (SELECT * FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) s FROM t)),
d AS (SELECT doc_id, coalesce({_W.format("text")}, []) w FROM documents),
g AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) s FROM d, (SELECT DISTINCT k FROM p))),
m AS (SELECT doc_id, s, g.k, item_id FROM g JOIN p ON g.g = p.g AND g.k = p.k),
h AS (SELECT doc_id, count(DISTINCT x) n FROM (SELECT doc_id, unnest(range(s, s + k)) x FROM m) GROUP BY 1),
l AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_hit, CAST(coalesce(len(items), 0) AS BIGINT) n_items, sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""
