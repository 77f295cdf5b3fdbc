"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed runs of five words. A set chooses a token when the token's
hash is below 1 / (threshold * size): similar sets choose alike, and a pair at the
threshold expects to share one choice. Sets that share a choice are a bucket; a bucket
over the size limit is split on further shared tokens, and its parts again, up to LEVELS
steps deep. A bucket of sets alike, as sketches against its first member tell, is a group
that no split takes apart: it isn't split but compared block against block, as is what is
still large at the end, so that nothing is dropped. Buckets that are small are compared
within themselves. All of it is repeated with other hashes, RUNS times: a run finds a
pair at the threshold with probability 0.63 in a bucket of the first step and 0.4 in one
of the second, so 12 runs miss it less than once in a hundred thousand or in four hundred.

Equal sets are one class from the start. A pair of classes that shares several
buckets is compared only in the smallest-numbered of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, mix, packed, release, shingles, sliced, table, twinned, utf8
from .components import components

WORDS, THRESHOLD, RUNS = 5, 0.8, 12
LEVELS = 3
#: Share of a bucket's sketches that its first member has, on average, from which it counts as a group of sets alike.
ALIKE = 0.5
#: Members above which a bucket is split, about as many as a block of a larger one has, and hashes
#: of the sketch that rules out pairs far apart.
LIMIT, BLOCK, SKETCH = 128, 512, 32
#: Similarity by the sketch (SKETCH smallest hashes) below which a pair isn't compared; at the
#: threshold itself this loses less than one pair in a million.
_FAR = 0.4

_ODD = mix(np.arange(1, LEVELS * RUNS + 1, dtype=np.uint64)) | np.uint64(1)
#: Numbers from here on stand for documents without a doc_id of their own: null ones, and further texts of one doc_id.
_OTHERS = 1 << 62


def choices(tokens: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Tokens chosen on each step, numbered by their run in the low four bits."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    at, run = [], []
    for k in range(0, len(tokens), 4096):
        i, r = np.nonzero(tokens[k : k + 4096, None] * _ODD[None] < limit)
        at.append(i + k)
        run.append(r)
    i, r = np.concatenate(at), np.concatenate(run)
    key = (mix(tokens[i] ^ _ODD[r]) & ~np.uint64(15)) | (r % RUNS).astype(np.uint64)
    return [key[r // RUNS == level].view(np.int64) for level in range(LEVELS)]


def sets(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, id, the set's key (null without words), size, choices by step and sketch, for rows of
    doc_id, id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            keys, sizes, chosen, sketch = [], [], [], []
            for text in utf8(batch.column(2)):
                tokens = shingles(text, words)
                sizes.append(len(tokens))
                if not len(tokens):
                    keys.append(None)
                    steps, s = [np.zeros(0, np.int64)] * LEVELS, np.zeros(0, np.int64)
                else:
                    other = mix(tokens + _ODD[0])
                    keys.append(f"{int(tokens.sum(dtype=np.uint64)):016x}{int(other.sum(dtype=np.uint64)):016x}")
                    steps = choices(tokens, threshold)
                    s = np.sort(np.partition(other, SKETCH - 1)[:SKETCH] if len(other) > SKETCH else other) >> np.uint64(33)
                chosen.append(steps)
                sketch.append(s.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(chosen, pa.list_(pa.list_(pa.int64()))), pa.array(sketch, pa.list_(pa.int32()))],
                ["doc_id", "id", "key", "size", "chosen", "sketch"],
            )
        release()

    return docs.mapInArrow(run, "doc_id bigint, id bigint, key string, size bigint, chosen array<array<bigint>>, sketch array<int>")


def buckets(reps: DataFrame, limit: int) -> DataFrame:
    """bucket, id and n (members) of the buckets that are left to compare."""
    at = reps.select("id", F.explode(F.col("chosen")[0]).alias("bucket"))
    out = None
    for level in range(LEVELS):
        n = at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        met = checkpoint(at.join(n, "bucket"))
        large = met.where(F.col("n") > limit)
        last = level == LEVELS - 1 or large.isEmpty()
        found = met if last else met.where(F.col("n") <= limit)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        marked = checkpoint(large.join(alike(large, reps), "bucket", "left"))
        out = out.unionByName(marked.where("alike").drop("alike"))
        steps = reps.select("id", F.col("chosen")[level + 1].alias("step"))
        # a part keeps its run's number in the low four bits
        at = marked.where("not alike").select("id", "bucket").join(steps, "id").select("id", F.explode(F.expr("transform(filter(step, x -> x & 15 = bucket & 15), x -> xxhash64(bucket, x) & -16 | bucket & 15)")).alias("bucket"))
    return out


def alike(large: DataFrame, reps: DataFrame) -> DataFrame:
    """bucket, alike: whether the members of a bucket have, on average, ALIKE of the smallest hashes of its
    first member; sums that are added up before they meet, so that a hot bucket is no hot task."""
    rows = large.select("bucket", "id").join(reps.select("id", F.slice("sketch", 1, 16).alias("s")), "id")
    first = rows.groupBy("bucket").agg(F.min_by("s", "id").alias("leader"))
    share = F.size(F.array_intersect("s", "leader")) / F.greatest(F.size("s"), F.size("leader"), F.lit(1))
    return rows.join(first, "bucket").groupBy("bucket").agg((F.avg(share) >= ALIKE).alias("alike"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of each task, from batches sorted by the first columns."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            rows = pa.concat_tables([rest, rows])
        key = [rows.column(k).to_numpy() for k in range(keys)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield rows.slice(a, b - a)
        rest = rows.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


def _common(lists: list[np.ndarray], weight: bool = False) -> np.ndarray:
    """For each two of the sorted lists, how many values they share."""
    n = len(lists)
    flat = np.concatenate(lists)
    own = np.repeat(np.arange(n), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = (np.bincount(column) > 1)[column] if len(flat) else new
    own, column = own[shared], column[shared]
    out = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        for start in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            dense = np.zeros((n, min(4096, int(column[-1]) + 1 - start)), np.float32)
            dense[own[a:b], column[a:b] - start] = 1
            out += dense @ dense.T
    return out


def candidates(reps: DataFrame, met: DataFrame, threshold: float, block: int) -> DataFrame:
    """bucket, i, j (a task), id and partners: the pairs to compare in each task."""
    own = met.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = met.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(id, bucket), blocks) as int)"))
    rows = rows.select("bucket", "id", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block")
    rows = rows.join(own, "id").join(reps.select("id", "size", "sketch"), "id")
    rows = rows.select("bucket", "i", "j", "id", "block", "size", F.filter("buckets", lambda b: b < F.col("bucket")).alias("before"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["bucket", "i", "j", "id", "partners"])
            for x in out:
                x.clear()
            return batch

        for rows in _groups(batches, 3):
            ids, block, size = (rows.column(k).to_numpy() for k in (3, 4, 5))
            n = len(ids)
            if n < 2:
                continue
            before = [np.array(x, np.int64) for x in rows.column(6).to_pylist()]
            sketch = [np.array(x, np.int64) for x in rows.column(7).to_pylist()]
            small = np.minimum(size[:, None], size[None])
            large = np.maximum(size[:, None], size[None])
            pair = np.triu(np.ones((n, n), bool), 1) & (small >= threshold * large)
            if rows.column(1)[0].as_py() != rows.column(2)[0].as_py():
                pair &= block[:, None] != block[None]
            if pair.any():
                pair &= _common(before) == 0
            if pair.any():
                # of the SKETCH smallest hashes of two sets together, those in both
                top = np.array([s[-1] if len(s) == SKETCH else 2**63 - 1 for s in sketch])
                shared = _common(sketch)
                length = np.array([len(s) for s in sketch])
                union = length[:, None] + length[None] - shared
                pair &= (shared >= _FAR * np.minimum(union, SKETCH)) | ((top[:, None] == 2**63 - 1) & (top[None] == 2**63 - 1))
            i, j = np.nonzero(pair)
            if not len(i):
                continue
            task = [rows.column(k)[0].as_py() for k in range(3)]
            for k in np.union1d(i, j).tolist():
                for column, value in zip(out, (*task, ids[k], ids[j[i == k]])):
                    column.append(value)
            if len(out[0]) >= 4096:
                yield flushed()
        if out[0]:
            yield flushed()
        release()

    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "bucket bigint, i int, j int, id bigint, partners array<bigint>")


def verified(docs: DataFrame, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """a, b, links: exact links, as a count for a, or with b as a link that joins two groups of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        out: list[list] = [[], [], []]
        for rows in _groups(batches, 3):
            place: dict[int, int] = {}
            members, partners = [], []
            for k, (x, p) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist())):
                if x not in place:
                    place[x] = len(members)
                    members.append(shingles(unpack(rows.column(5)[k].as_py()), words))
                    partners.append(p)
            ids = list(place)
            shared = _common(members)
            size = np.array([len(m) for m in members])
            count, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for a, p in enumerate(partners):
                b = np.array([place[x] for x in p if x in place], np.int64)
                hit = b[shared[a, b] >= threshold * (size[a] + size[b] - shared[a, b]) - 1e-6] if len(b) else b
                count[a] += len(hit)
                count[hit] += 1
                for k in hit.tolist():
                    if (x := top(a)) != (y := top(k)):
                        root[max(x, y)] = min(x, y)
                        for column, value in zip(out, (ids[a], ids[k], 0)):
                            column.append(value)
            for k in np.flatnonzero(count).tolist():
                for column, value in zip(out, (ids[k], None, count[k])):
                    column.append(value)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])
        release()

    rows = pairs.join(packed(docs.select("id", "text")), "id").select("bucket", "i", "j", "id", "partners", "packed")
    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a bigint, b bigint, links bigint")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, rep_id and n_links of each row of docs.

    Texts with equal sets of runs of words are one class, named by its smallest doc_id,
    rep_id. n_links is the number of other classes at least as similar as the
    threshold, and class_id the smallest doc_id of all classes that links connect.
    A text of fewer words than a run is one run; a null, empty or blank text has
    none, links to nothing and is its own class. Equal rows are one document; different
    texts under one doc_id are several; texts with a null doc_id take part, and a class
    of them alone has a null class_id. An empty table gives no rows; other columns
    are left out. Texts are read whole.
    """
    named = classes(numbered(docs.select(F.col("doc_id").cast("long"), "text")), words, threshold, limit, block)
    doc_ids = named.where(F.col("id") >= _OTHERS).select(F.col("id").alias("number"), F.col("doc_id").alias("of")).distinct()
    for c in ("class_id", "rep_id"):
        named = named.join(doc_ids, F.col(c) == F.col("number"), "left").withColumn(c, F.when(F.col(c) < _OTHERS, F.col(c)).otherwise(F.col("of"))).drop("number", "of")
    return named.select("doc_id", "class_id", "rep_id", "n_links")


def numbered(docs: DataFrame) -> DataFrame:
    """Adds id: the doc_id, or a number from _OTHERS on by hash for a null one or a further text of one."""
    rows = twinned(docs)
    other = F.lit(_OTHERS) + F.shiftrightunsigned(F.xxhash64("doc_id", "twin", "text"), 3)
    return rows.withColumn("id", F.when(F.col("doc_id").isNotNull() & (F.col("twin") == 0), F.col("doc_id")).otherwise(other)).drop("twin")


def classes(docs: DataFrame, words: int, threshold: float, limit: int, block: int) -> DataFrame:
    """doc_id, id, class_id, rep_id and n_links of each row of doc_id, id and text, classes by id."""
    all_sets = checkpoint(sets(docs.select("doc_id", "id", "text"), words, threshold))
    reps = all_sets.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "chosen", "sketch")])
    reps = checkpoint(reps)
    met = buckets(reps, limit)
    found = checkpoint(verified(docs, candidates(reps, met, threshold, block), words, threshold))
    groups = components(found.where("b is not null"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep_id")).agg(F.sum("links").alias("n_links"))
    each = reps.select("key", F.col("id").alias("rep_id")).join(counts, "rep_id", "left").join(groups.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    return all_sets.select("doc_id", "id", "key").join(each, "key", "left").select(
        "doc_id", "id", F.coalesce("component", "rep_id", "id").alias("class_id"), F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that are the first of the class of connected texts.

    A class is what links connect, so a row may go that is linked to the one that stays
    only by way of others. The first has the smallest doc_id; of texts with a null doc_id
    the one of the smallest hash stays, if no other is in its class. Equal rows are one
    document, of which one row stays, the one of the smallest hash where other columns
    differ; different texts under one doc_id are told apart. Null, empty and blank
    texts are each their own class. An empty table stays empty; other columns may have
    any names.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text", F.struct("*").alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("order")))
    kept = classes(rows, words, threshold, LIMIT, BLOCK).where("id = class_id").select("id").distinct()
    return rows.select("id", "row", "order").join(kept, "id", "left_semi").groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) i FROM w WHERE len(ws) > 0)
), k AS (
  SELECT doc_id, count(*) n, md5(string_agg(gram, e'\x01' ORDER BY gram)) AS body FROM g GROUP BY doc_id
), c AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY body) rep FROM k
), r AS (
  SELECT g.doc_id, gram, n FROM g JOIN c ON g.doc_id = c.doc_id WHERE c.rep = c.doc_id
), j AS (
  SELECT a.doc_id a, b.doc_id b FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), cc AS (
  SELECT DISTINCT a node, a root FROM j
  UNION
  SELECT j.b, cc.root FROM cc JOIN j ON j.a = cc.node
), m AS (
  SELECT node, min(root) root FROM cc GROUP BY node
)
SELECT d.doc_id, coalesce(m.root, c.rep, d.doc_id) class_id, coalesce(c.rep, d.doc_id) rep_id,
  coalesce((SELECT count(*) FROM j WHERE j.a = c.rep), 0) n_links
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON m.node = c.rep
"""
