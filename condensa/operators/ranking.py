"""Ranking of sections and vectors, chunking under a budget."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import batches as B
from ..functions import text as T
from . import scoring, structure


def _postings(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, token, tf, len) and one row of n and mean length."""
    t = rows.select(key, T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    tf = t.select(key, F.size("t").alias("len"), F.explode("t").alias("token")).groupBy(key, "token", "len").agg(F.count("*").alias("tf"))
    return tf, t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query. A rank within parts of the documents goes before the
    last one, so that a query whose tokens stand in most documents isn't ranked in one task."""
    order = (F.desc("score"), F.col("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", part).orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best documents of each query by BM25, a token that the query has q times weighing q / (q + 1).

    Queries of up to scoring.MOST_ASKED tokens go to the tasks, each of which keeps its best documents; more
    are joined, token by token, with the documents' tokens. Null texts and texts without tokens have no score."""
    asked = queries.select("item_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("q"))
    rows = scoring.held(asked, scoring.MOST_ASKED) if scoring.suits(docs, queries) else None
    if rows:
        found = scoring.bm25(docs, [tuple(r) for r in rows], k, k1, b)
        return _best(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), k)
    t = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    stats = t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    wanted = asked.select("token").distinct()
    tf = t.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("token")).join(wanted, "token", "left_semi").groupBy("doc_id", "token", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    scored = asked.join(df, "token").join(tf, "token").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) * F.col("q") / (F.col("q") + 1)
    return _best(scored.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")), k)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query by the cosine of tf-idf vectors; a query counts as one more
    document of its own corpus, as do its tokens.

    Queries of up to scoring.MOST_ASKED tokens go to the tasks, and only candidates are shuffled; more are joined."""
    q, _ = _postings(queries, "item_id")
    rows = scoring.held(q.select("item_id", "token", F.col("tf") / F.col("len")), scoring.MOST_ASKED) if scoring.suits(docs, queries) else None
    if rows:
        found = scoring.tfidf(docs, [tuple(r) for r in rows], k)
        return _best(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), k)
    tf, stats = _postings(docs, "doc_id")
    counts = tf.groupBy("token").agg(F.count("*").alias("df"))
    # n documents and the query; a token of the query has one document more
    idf = lambda more: F.log((F.col("n") + 2) / (F.coalesce("df", F.lit(0)) + more + 1)) + 1
    own = q.join(counts, "token", "left").join(F.broadcast(stats)).select("item_id", "token", "df", (F.col("tf") / F.col("len") * idf(1)).alias("v"), idf(1).alias("idf"), idf(0).alias("plain"))
    d = tf.join(counts, "token").join(F.broadcast(stats)).select("doc_id", "token", (F.col("tf") / F.col("len")).alias("f"), idf(0).alias("plain"))
    squares = d.groupBy("doc_id").agg(F.sum((F.col("f") * F.col("plain")) ** 2).alias("square"))
    # the document's norm for this query: tokens they share weigh otherwise than in the corpus alone
    shared = own.join(d.select("doc_id", "token", "f"), "token").groupBy("item_id", "doc_id").agg(
        F.sum(F.col("v") * F.col("f") * F.col("idf")).alias("dot"), F.sum(F.col("f") ** 2 * (F.col("idf") ** 2 - F.col("plain") ** 2)).alias("change"))
    norm = own.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("v_norm"))
    scored = shared.join(squares, "doc_id").join(norm, "item_id")
    return _best(scored.select("item_id", "doc_id", F.round(F.col("dot") / (F.sqrt(F.col("square") + F.col("change")) * F.col("v_norm")), 6).alias("score")), k)


def luhn(docs: DataFrame, top: int = 12) -> DataFrame:
    """Share of a document's longer tokens that are among its most frequent."""
    t = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).where("length(token) > 2").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token"))
    return t.withColumn("rank", rank).groupBy("doc_id").agg((F.sum(F.when(F.col("rank") <= top, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))


def adjacent_groups(vectors: DataFrame, threshold: float = 0.6, lanes: int = 256) -> DataFrame:
    """vec_id and run: runs of neighbouring vectors by id, cut where the cosine of two in a row, of unit
    vectors, falls below the threshold. Runs are numbered from 1 over the whole table.

    Rows are dealt into `lanes` ranges of ids; each lane's last vector goes to the next lane
    that has rows, and cuts are counted over lanes, so no task orders the whole table."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bounds = rows.agg(F.min("vec_id").alias("low"), (F.max("vec_id") - F.min("vec_id") + 1).alias("wide"))  # one row
    rows = rows.join(F.broadcast(bounds)).select("vec_id", "v", F.expr(f"cast((vec_id - low) * {lanes} / wide as int)").alias("lane"))
    w = Window.partitionBy("lane").orderBy("vec_id")
    carry = rows.groupBy("lane").agg(F.max_by("v", "vec_id").alias("carry"))  # a row a lane
    before = carry.select("lane", F.lag("carry").over(Window.orderBy("lane")).alias("carry"))
    rows = rows.withColumn("p", F.lag("v").over(w)).join(before, "lane").withColumn("p", F.coalesce("p", "carry"))
    dot = F.expr("aggregate(zip_with(v, p, (a, b) -> a * b), 0D, (s, x) -> s + x)")
    rows = rows.select("vec_id", "lane", F.when(F.col("p").isNull() | (dot < threshold), 1).otherwise(0).alias("cut"))
    cuts = rows.groupBy("lane").agg(F.sum("cut").alias("cuts"))
    start = cuts.select("lane", F.coalesce(F.sum("cuts").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(start, "lane").select("vec_id", (F.col("start") + F.sum("cut").over(w)).alias("run"))


def packed_chunks(docs: DataFrame, size: int = 200) -> DataFrame:
    """Sentences packed into chunks of at most `size` tokens, a longer sentence alone."""
    rows = docs.select("doc_id", F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), T.n_tokens(s).alias("n"))).alias("parts"))
    packed = F.expr(f"""aggregate(parts, struct(cast(array() as array<struct<text:string,n:bigint>>) as done, '' as text, 0L as n),
        (acc, x) -> if(acc.n > 0 and acc.n + x.n > {size},
            struct(array_append(acc.done, struct(acc.text, acc.n)) as done, x.s as text, x.n as n),
            struct(acc.done as done, if(acc.n = 0, x.s, acc.text || ' ' || x.s) as text, acc.n + x.n as n)),
        acc -> if(acc.n > 0, array_append(acc.done, struct(acc.text, acc.n)), acc.done))""")
    return rows.select("doc_id", F.posexplode(packed).alias("chunk", "c")).select("doc_id", "chunk", "c.text", F.col("c.n").alias("n_tokens"))


def fixed_chunks(docs: DataFrame, size: int = 200, overlap: float = 0.1) -> DataFrame:
    """Windows of `size` words that overlap by a share."""
    step = size - int(size * overlap)
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return rows.select("doc_id", "t", F.posexplode(F.expr(f"sequence(0, size(t) - 1, {step})")).alias("chunk", "at")).select("doc_id", "chunk", F.array_join(F.slice("t", F.col("at") + 1, size), " ").alias("text"))


#: The budget's share of the tokens, its bounds, the most sentences, and what must be saved.
BUDGET, LEAST, MOST, SENTENCES, SAVED = 0.7, 0.2, 0.95, 120, 0.08


def sentence_scores(docs: DataFrame, query: str | None = None) -> DataFrame:
    """doc_id, pos, n_tokens, protected and score of each sentence.

    The score is 0.45 of the share of the query's tokens it has (0 without a query), 0.3 if it
    names a constraint or holds a placeholder, 0.15 over the number of sentences with its
    set of tokens, and 0.1 of its tokens' entropy over the largest possible."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("t", T.tokens(F.col("sentence"))).withColumn("set", F.array_sort(F.array_distinct("t")))
    same = F.count("*").over(Window.partitionBy("doc_id", "set"))
    protected = T.has_constraint(F.col("sentence")) | F.col("sentence").rlike(r"__[A-Za-z0-9_]+_[0-9]+__")
    counts = F.expr("transform(set, x -> size(filter(t, y -> y = x)) / size(t))")
    entropy = F.when(F.size("set") > 1, F.least(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log(p)) / F.log(F.size("set")), F.lit(1.0))).otherwise(0.0)
    asked = F.array(*[F.lit(x) for x in sorted(set(re.findall(T.TOKEN, (query or "").lower())))]).cast("array<string>")
    relevance = F.size(F.array_intersect("set", asked)) / F.greatest(F.size(asked), F.lit(1))
    score = 0.45 * relevance + 0.3 * protected.cast("int") + 0.15 / same + 0.1 * entropy
    return s.select("doc_id", "pos", T.n_tokens(F.col("sentence")).alias("n_tokens"), protected.alias("protected"), F.size("t").alias("size"), "set", F.round(score + 1e-9, 6).alias("score"))


def budget_ratios(scored: DataFrame, asked: bool = False) -> DataFrame:
    """doc_id, n_sentences, total and ratio: the share of its tokens a text may keep, from how many of its
    sentences are protected and how many repeat an earlier one's set of tokens."""
    rows = scored.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n_tokens").alias("total"), F.count_if("protected").alias("hits"), F.countDistinct("set").alias("kinds"))
    dense, again = F.col("hits") / F.col("n_sentences"), 1 - F.col("kinds") / F.col("n_sentences")
    more = F.when(dense >= 0.2, 0.1).when(dense >= 0.1, 0.05).otherwise(0.0)
    less = F.when((again >= 0.35) & (dense <= 0.18), 0.12).when((again >= 0.22) & (dense <= 0.12), 0.07).otherwise(0.0)
    ratio = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.lit(BUDGET) + more - less))
    floor = F.when(dense >= 0.15, 0.6).when(again < 0.2, 0.58).otherwise(0.5)
    return rows.select("doc_id", "n_sentences", "total", F.round(ratio if asked else F.greatest(ratio, floor), 6).alias("ratio"))


def within_budget(scored: DataFrame, ratios: DataFrame) -> DataFrame:
    """doc_id, pos of the sentences kept: the protected ones, then the best while they fit the budget; one
    that doesn't fit is skipped and the rest still tried, until SENTENCES are kept or the budget is met.

    A text that would save less than SAVED of its tokens keeps all, as does one of a single sentence."""
    order = F.struct((~F.col("protected")).alias("open"), (-F.col("score")).alias("key"), "pos", F.col("n_tokens").alias("n"))
    rows = scored.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("s")).join(ratios, "doc_id")
    kept = F.expr(f"""aggregate(s, struct(cast(array() as array<int>) as pos, 0L as used), (acc, x) -> if(
        not x.open or size(acc.pos) < {SENTENCES} and acc.used < goal and (size(acc.pos) = 0 or acc.used + x.n <= goal),
        struct(array_append(acc.pos, x.pos) as pos, acc.used + x.n as used), acc))""")
    rows = rows.withColumn("goal", F.greatest(F.floor(F.col("total") * F.col("ratio")), F.lit(1))).withColumn("k", kept)
    whole = (F.col("n_sentences") < 2) | (F.col("goal") >= F.col("total")) | ((F.col("total") - F.col("k.used")) / F.col("total") < SAVED)
    return rows.select("doc_id", F.explode(F.when(whole, F.array_sort(F.col("s.pos"))).otherwise(F.array_sort("k.pos"))).alias("pos"))


#: Bounds of memory: texts go through the selection together up to so many pairs of sections, and so many that share a token.
TOGETHER = 1 << 20


def _in_step(score: np.ndarray, near: np.ndarray, share: float) -> np.ndarray:
    """The order of the sections of texts of one shape, a step for all of them at once. score (texts x sections) is -inf
    where a text has no more sections, near (texts x sections x sections) the overlaps."""
    value, most, every = share * score, np.zeros_like(score), np.arange(len(score))
    out = np.zeros(score.shape, np.int64)
    for step in range(score.shape[1]):
        best = np.argmax(value - (1 - share) * most, axis=1)
        out[:, step] = best
        value[every, best] = -np.inf
        np.maximum(most, near[every, best], out=most)
    return out


def _one_by_one(score: np.ndarray, size: np.ndarray, token: np.ndarray, share: float) -> np.ndarray:
    """The order of the sections of one text; a section taken meets only those that it shares a token with."""
    n = len(score)
    start = np.concatenate(([0], np.cumsum(size)))
    section = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    holders, first = section[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
    value, most, out = share * score, np.zeros(n), np.zeros(n, np.int64)
    for step in range(n):
        best = int(np.argmax(value - (1 - share) * most))
        out[step] = best
        value[best] = -np.inf
        if size[best]:
            both = np.zeros(n, np.int64)
            for t in token[start[best] : start[best + 1]].tolist():
                both[holders[first[t] : first[t + 1]]] += 1  # a section has a token once
            np.maximum(most, both / (size + size[best] - both), out=most)
    return out


def _selected(score: np.ndarray, sections: np.ndarray, size: np.ndarray, token: np.ndarray, share: float) -> np.ndarray:
    """For texts one after another the places of their sections in the order in which they are taken.

    sections counts each text's sections, size each section's tokens, token numbers them. Scores fall within a text."""
    first, upto = np.concatenate(([0], np.cumsum(sections))), np.concatenate(([0], np.cumsum(size)))
    out = np.arange(len(score)) - np.repeat(first[:-1], sections)
    text = np.repeat(np.repeat(np.arange(len(sections)), sections), size)
    # runs of one token of a text; what meets in a run shares it
    kinds = int(token.max()) + 1 if len(token) else 1
    order = np.argsort(text * kinds + token, kind="stable")
    section, key = np.repeat(np.arange(len(score)), size)[order], (text * kinds + token)[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate((edge, [len(key)])))
    met = np.bincount(text[order][edge], run * run, len(sections)).astype(np.int64)
    run_of, begin = np.repeat(run, run), np.repeat(edge, run)
    many = np.flatnonzero(sections > 3)
    small = (met[many] <= TOGETHER >> 2) & (sections[many] <= 512)
    for i in many[~small].tolist():
        a, b = first[i], first[i + 1]
        own = np.unique(token[upto[a] : upto[b]], return_inverse=True)[1]
        out[a:b] = _one_by_one(score[a:b], size[a:b], own, share)
    many = many[small][np.argsort(sections[many[small]], kind="stable")]
    at = 0
    while at < len(many):
        # the largest text comes last, so its number of sections is the width of all
        end = at + 1
        pairs = met[many[at]]
        while end < len(many) and (end + 1 - at) * sections[many[end]] ** 2 <= TOGETHER and pairs + met[many[end]] <= TOGETHER:
            pairs += met[many[end]]
            end += 1
        group, width = many[at:end], int(sections[many[end - 1]])
        n = sections[group]
        row = np.repeat(np.arange(len(group)), n)
        column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        member = np.repeat(first[group], n) + column
        held, sizes = np.full((len(group), width), -np.inf), np.zeros((len(group), width))
        held[row, column], sizes[row, column] = score[member], size[member]
        tokens = upto[first[group + 1]] - upto[first[group]]
        entry = np.repeat(upto[first[group]], tokens) + np.arange(tokens.sum()) - np.repeat(np.cumsum(tokens) - tokens, tokens)
        width_of, own = run_of[entry], np.repeat(np.arange(len(group)), tokens)
        # each section beside all those of its run
        left = np.repeat(entry, width_of)
        right = np.repeat(begin[entry], width_of) + np.arange(len(left)) - np.repeat(np.cumsum(width_of) - width_of, width_of)
        base = np.repeat(first[group], tokens)
        x, y = np.repeat(section[entry] - base, width_of), section[right] - np.repeat(base, width_of)
        both = np.bincount((np.repeat(own, width_of) * width + x) * width + y, minlength=len(group) * width * width).reshape(len(group), width, width)
        either = sizes[:, :, None] + sizes[:, None, :] - both
        near = np.divide(both, either, out=np.zeros(both.shape), where=either > 0)
        out[member] = _in_step(held, near, share)[row, column]
        at = end
    return out


def mmr_order(scored: DataFrame, key: str = "doc_id", share: float = 0.7) -> DataFrame:
    """key, pos, place: sections in the order of most marginal relevance, for rows of key, pos, score and set
    (distinct tokens); see mmr_sections."""
    return mmr_sections(scored.groupBy(key).agg(F.collect_list(F.struct("pos", "score", "set")).alias("s")), key, share)


def mmr_sections(rows: DataFrame, key: str = "doc_id", share: float = 0.7) -> DataFrame:
    """key, pos, place: sections in the order of most marginal relevance, for rows of key and s, a text's sections (pos,
    score and set, its distinct tokens).

    The next is the one with the largest share x score - (1 - share) x its largest overlap with those
    taken, ties to the better score, then the first. Fewer than four sections go by score. Texts with few
    sections are selected from together, longer ones alone; there is no shuffle."""
    ordered = F.array_sort(F.transform("s", lambda x: F.struct((-x["score"]).alias("key"), x["pos"].alias("pos"), x["set"].alias("set"))))
    rows = rows.select(key, ordered.alias("s")).select(key, F.col("s.pos").alias("pos"), F.col("s.key").alias("score"), F.col("s.set").alias("set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a section counts as a token more
        tokens = lambda b: np.diff(b.column(3).values.offsets.to_numpy()[b.column(3).offsets.to_numpy()]) + np.diff(b.column(3).offsets.to_numpy())
        for batch in B.sliced(batches, tokens, B.CHUNK >> 2):
            sections, sets = B.list_sizes(batch, 3), batch.column(3).flatten()
            size = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            token = pc.fill_null(sets.flatten().dictionary_encode().indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            score = -batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            taken = _selected(score, sections, size, token, share)
            first = np.repeat(np.cumsum(sections) - sections, sections)
            place = np.arange(len(taken)) - first
            pos = batch.column(1).flatten().take(pa.array(first + taken))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sections))), pos, pa.array(place, pa.int32())], [key, "pos", "place"])
        B.release()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, pos {kinds['pos'].removeprefix('array<').removesuffix('>')}, place int")


def attention_order(ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, place: of sections by place, those of the best third go in front and behind in turn, and
    the rest in between, in order."""
    n = F.count("*").over(Window.partitionBy(key))
    rows = ranked.withColumn("top", F.greatest(F.lit(1), F.floor(n / 3)))
    # in front go the places 0, 2, 4, each before the last, behind 1, 3, 5; the middle of these is where the rest goes
    spot = F.when(F.col("place") % 2 == 0, F.ceil(F.col("top") / 2) - 1 - F.col("place") / 2).otherwise(F.ceil(F.col("top") / 2) + (F.col("place") - 1) / 2)
    where = F.when(F.col("place") >= F.col("top"), F.col("place") * 1.0).when(spot < F.floor(F.col("top") / 2), spot - 1e9).otherwise(spot + 1e9)
    rows = rows.select(key, "pos", where.alias("at"))
    return rows.select(key, "pos", (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("place"))


def auto_budget(total: Column, candidate: Column, share: float = 0.7) -> Column:
    """The larger of candidate and a share of total; null where that isn't below total."""
    budget = F.greatest(candidate, F.floor(total * share).cast("long"))
    return F.when((total > 0) & (total > candidate) & (budget < total), F.greatest(budget, F.lit(1)))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int, key: str, item: str) -> DataFrame:
    """key, hits, n, recall: how many of each key's relevant items are among its first k."""
    found = ranked.where(F.col("rank") <= k).select(key, item, F.lit(1).alias("hit"))
    rows = relevant.select(key, item).distinct().join(found, [key, item], "left").groupBy(key).agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return rows.withColumn("recall", F.col("hits") / F.col("n"))


def holders(docs: DataFrame, passages: DataFrame, words: int) -> DataFrame:
    """item_id and doc_id of documents that hold a passage of an item, for rows of item_id and t, a run of so many tokens.

    Up to scoring.MOST_ASKED tokens of passages go to the tasks; more meet the documents' runs in a join."""
    rows = scoring.held(passages.select("item_id", "t"), scoring.MOST_ASKED // words) if scoring.suits(docs, passages) else None
    if rows is not None:
        return scoring.holders(docs, [tuple(r) for r in rows], words).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    grams = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= words).select("doc_id", F.explode(F.expr(f"transform(sequence(1, size(t) - {words - 1}), i -> array_join(slice(t, i, {words}), ' '))")).alias("g"))
    return grams.join(passages.select("item_id", F.array_join("t", " ").alias("g")), "g").select("item_id", "doc_id")


def lexrank(docs: DataFrame) -> DataFrame:
    """Each sentence's sum of tf-idf cosines to the other sentences of its document.

    The sum of cosines is the product with the sum of the unit vectors, so no pairs are
    formed. All windows follow the one shuffle by document."""
    s = docs.repartition("doc_id").select("doc_id", F.transform(T.sentences(F.col("text")), T.tokens).alias("s"))
    s = s.select("doc_id", F.size(F.filter("s", lambda t: F.size(t) > 0)).alias("n"), F.posexplode("s").alias("pos", "t")).where("size(t) > 0")
    tf = s.select("doc_id", "n", "pos", F.size("t").alias("len"), F.explode("t").alias("token")).groupBy("doc_id", "n", "pos", "len", "token").agg(F.count("*").alias("c"))
    same = Window.partitionBy("doc_id", "token")
    w = tf.withColumn("w", F.col("c") / F.col("len") * (F.log((F.col("n") + 1) / (F.count("*").over(same) + 1)) + 1))
    u = w.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "pos"))))
    return u.withColumn("all", F.sum("u").over(same)).groupBy("doc_id", "pos").agg(F.greatest(F.sum(F.col("u") * F.col("all")) - 1, F.lit(0.0)).alias("score"))


def nearest_sections(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors of largest cosine to the embedding of query's one row; those without a length are left out."""
    v, q = F.col("embedding").cast("array<double>"), F.col("q")
    vectors = vectors.join(F.broadcast(query.limit(1).select(F.col("embedding").cast("array<double>").alias("q"))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(v, v) * dot(q, q))
    return vectors.select("vec_id", F.round(F.when(size > 0, dot(v, q) / size), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


def sentence_entropy(docs: DataFrame) -> DataFrame:
    """Entropy of a sentence's words over that of as many equally frequent ones; 0 for one word."""
    s = docs.repartition("doc_id").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    c = s.select("doc_id", "pos", F.explode(T.tokens(F.col("s"))).alias("token")).groupBy("doc_id", "pos", "token").agg(F.count("*").alias("c"))
    bits = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    return c.groupBy("doc_id", "pos").agg(F.when(F.count("*") > 1, F.least(bits / F.log(F.count("*")), F.lit(1.0))).otherwise(0.0).alias("entropy"))


def idf_weights(docs: DataFrame) -> DataFrame:
    """token and ln((1 + n) / (1 + df)) + 1, over texts with a token."""
    tf, stats = _postings(docs, "doc_id")
    df = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(stats))  # stats is one row
    return df.select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def chat_chunks(turns: DataFrame, size: int = 200) -> DataFrame:
    """conv_id, chunk, text and n_tokens: lines of turns packed in order into chunks of at most `size` tokens, a
    longer line alone."""
    line = F.concat("role", F.lit(": "), F.regexp_replace(F.btrim(F.coalesce("text", F.lit(""))), "[\\n\\r]+", " "))
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("s"))
    rows = lines.select(F.col("conv_id").alias("doc_id"), F.transform("s", lambda x: F.struct(x["l"].alias("s"), T.n_tokens(x["l"]).alias("n"))).alias("parts"))
    packed = F.expr(f"""aggregate(parts, struct(cast(array() as array<struct<text:string,n:bigint>>) as done, '' as text, 0L as n),
        (acc, x) -> if(acc.n > 0 and acc.n + x.n > {size},
            struct(array_append(acc.done, struct(acc.text, acc.n)) as done, x.s as text, x.n as n),
            struct(acc.done as done, if(acc.n = 0, x.s, acc.text || '\\n' || x.s) as text, acc.n + x.n as n)),
        acc -> if(acc.n > 0, array_append(acc.done, struct(acc.text, acc.n)), acc.done))""")
    return rows.select(F.col("doc_id").alias("conv_id"), F.posexplode(packed).alias("chunk", "c")).select("conv_id", "chunk", "c.text", F.col("c.n").alias("n_tokens"))


def gzip_scores(rows: DataFrame, query: str) -> DataFrame:
    """Adds score: 1 less the compression distance of text and query, 0 at the least; 0 for null and empty texts.

    Each text is compressed by itself, in Arrow batches; there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lambda data: len(gzip.compress(data, mtime=0))
        asked = query.encode()
        own = size(asked)
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                if not text:
                    out.append(0.0)
                    continue
                n = size(text)
                out.append(max(0.0, 1 - (size(text + asked) - min(own, n)) / max(own, n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


#: The ways of ranking sections, by name; each gives rows with a score.
MODES = {"bm25": bm25, "tfidf": tfidf, "lexrank": lexrank, "luhn": luhn, "gzip": gzip_scores}


def ranked(mode: str, *args, **options) -> DataFrame:
    """What the named way of ranking gives; an unknown name is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown ranking {mode!r}; known are {', '.join(sorted(MODES))}")
    return MODES[mode](*args, **options)


def chunked(docs: DataFrame, strategy: str, size: int = 200, overlap: float = 0.1) -> DataFrame:
    """doc_id, chunk, text by a strategy: off (whole texts), fixed (windows of words) or structured (sentences)."""
    if strategy == "fixed":
        return fixed_chunks(docs, size, overlap)
    if strategy == "structured":
        return packed_chunks(docs, size).select("doc_id", "chunk", "text")
    if strategy == "off":
        return docs.select("doc_id", F.lit(0).alias("chunk"), "text")
    raise ValueError(f"unknown strategy {strategy!r}")


def fewest_tokens(candidates: DataFrame, key: str, threshold: float) -> DataFrame:
    """The candidate of each key with the fewest tokens, of those at least so similar to the original that keep
    its constraints; ties go to the more similar, then the first name. Keys without one have no row.

    Rows are of key, name, text, original."""
    keeps = F.regexp_count("original", F.lit(T.CONSTRAINT)) == F.regexp_count("text", F.lit(T.CONSTRAINT))
    rows = candidates.withColumn("similarity", T.similarity(F.col("original"), F.col("text"))).where((F.col("similarity") >= threshold) & keeps)
    best = F.min_by(F.struct("name", "text", "similarity"), F.struct(T.n_tokens(F.col("text")), -F.col("similarity"), "name"))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.name", "b.text", "b.similarity")


def section_ranking(docs: DataFrame, query: str, candidate: int = 200, share: float = 0.7) -> DataFrame:
    """doc_id, pos of the paragraphs kept: headed ones first, then by how many of the query's tokens they have,
    while they fit a share of the text's tokens; one that doesn't fit is skipped and the rest still tried.

    Texts that the budget holds keep all."""
    asked = F.array(*[F.lit(x) for x in sorted(set(re.findall(T.TOKEN, query.lower())))]).cast("array<string>")
    facts = F.transform(T.paragraphs(F.col("text")), lambda p, i: F.struct(
        F.when(p.rlike(structure.HEADER), 0).otherwise(1).alias("open"), (-F.size(F.array_intersect(F.array_distinct(T.tokens(p)), asked)) / F.greatest(F.size(asked), F.lit(1))).alias("key"), i.alias("pos"), T.n_tokens(p).alias("n")))
    rows = docs.select("doc_id", F.array_sort(facts).alias("s"), auto_budget(T.n_tokens(F.col("text")), F.lit(candidate), share).alias("goal")).where("size(s) > 0")
    kept = F.expr("aggregate(s, struct(cast(array() as array<int>) as pos, 0L as used), (acc, x) -> if(acc.used + x.n <= goal or size(acc.pos) = 0, struct(array_append(acc.pos, x.pos) as pos, acc.used + x.n as used), acc)).pos")
    return rows.select("doc_id", F.explode(F.array_sort(F.when(F.col("goal").isNull(), F.col("s.pos")).otherwise(kept))).alias("pos"))
