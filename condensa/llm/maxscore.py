"""Exact top-k inner products by MaxScore over shards of the index.

A vector's component is an impact: a positive one is in the posting list of
(component, +), a negative one in that of (component, -). A query meets the lists of
its own signs, which only add to a score; components of the other sign only
subtract. So the summed bounds of a query's lists bound its scores. Lists are in
order of their bounds; those whose bounds together stay below the k-th best score so
far are non-essential: a row only in them can't enter. Rows in essential lists are
gathered, and the other lists are probed from the largest bound down, while a row's
sum and the bounds left are competitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import best, grid_search, matrix, sampled, usable

#: Rows whose postings are traversed together.
BLOCK = 1024
#: Rows scored first, at most, whose k-th best is where every shard's threshold starts.
FIRST = 2048
#: A threshold that every score meets.
_NONE = -(2**62)


class Postings:
    """The lists of one block of rows, and the largest impact of each."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        wide = rows.shape[1]
        self.size = np.abs(rows)
        self.lists = [np.flatnonzero(rows[:, j] * s > 0) for s in (1, -1) for j in range(wide)]
        self.bound = np.array([self.size[ids, t % wide].max(initial=0) for t, ids in enumerate(self.lists)])

    def search(self, query: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score at least floor, with their exact scores."""
        wide = len(query)
        terms = np.flatnonzero(query)
        terms = np.where(query[terms] > 0, terms, wide + terms)
        weight = np.abs(query[terms % wide])
        bound = weight * self.bound[terms]
        order = np.argsort(-bound, kind="stable")
        terms, weight, bound = terms[order], weight[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        essential = int(np.searchsorted(-rest, -floor, "right"))  # rest[essential:] < floor
        if floor <= 0:
            essential = len(terms)
        total = np.zeros(len(self.rows), np.int64)
        for t, w in zip(terms[:essential], weight[:essential]):
            ids = self.lists[t]
            total[ids] += w * self.size[ids, t % wide]
        if floor <= 0:
            live = np.arange(len(total))
        else:
            live = np.flatnonzero(total + rest[essential] >= floor)
        for n in range(essential, len(terms)):
            if not len(live):
                break
            j = terms[n] % wide
            x = self.rows[live, j] * (1 if terms[n] < wide else -1)
            total[live] += weight[n] * np.maximum(x, 0)
            live = live[total[live] + rest[n + 1] >= floor]
        score = self.rows[live] @ query
        keep = score >= floor
        return live[keep], score[keep]


#: With components below it, products of 2048 components at a scale of 1024 fit 64 bits.
LARGEST = 65536.0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products.

    Components become floor(scale * x). Rows with the query's vec_id are not
    candidates; repeated rows are candidates each, repeated query ids ask once. Ties go
    to the smaller vec_id. Null vec_ids, and vectors null, empty or with null or
    non-finite components, take no part, nor do those with a component of LARGEST or more in
    size, whose products 64-bit scores couldn't hold; of different vectors under one query id the least in
    order asks; a shorter vector counts as filled with
    zeros; an empty table gives no rows; other columns are left out.

    A query's threshold starts from the k-th best of at most FIRST rows, one sample for
    all shards, so that none has to score its first rows without one.
    """
    index, asked = usable(vectors, most=LARGEST), usable(queries, most=LARGEST)
    n = index.count()
    first = vectors.sparkSession.sparkContext.broadcast(sampled(index, FIRST))
    whole = lambda a: np.floor(scale * a).astype(np.int64)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = first.value
        rows = whole(rows)
        for batch in batches:
            q = whole(matrix(batch.column(1)))
            wide = max(q.shape[1], rows.shape[1])
            q, x = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (q, rows))
            out = np.full(len(q), _NONE)
            if len(ids):
                for part in range(0, len(q), 256):
                    score = q[part : part + 256] @ x.T
                    score[batch.column(0).to_numpy()[part : part + 256, None] == ids[None]] = _NONE
                    if len(ids) >= k:
                        out[part : part + 256] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["vec_id", "embedding", "floor"])

    asked = asked.mapInArrow(floors, "vec_id bigint, embedding array<double>, floor bigint")

    def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, floors: np.ndarray):
        rows, query_rows = whole(rows), whole(query_rows)
        blocks = [Postings(rows[b : b + BLOCK]) for b in range(0, len(rows), BLOCK)]
        out = []
        for q, query, floor in zip(query_ids, query_rows, floors.tolist()):
            have, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b, postings in enumerate(blocks):
                at, s = postings.search(query, floor)
                new = ids[b * BLOCK + at]
                own = new != q
                have, score = np.concatenate((have, new[own])), np.concatenate((score, s[own]))
                top = best(have, score, k)
                have, score = have[top], score[top]
                if len(score) == k:
                    floor = max(floor, int(score[-1]))
            out.append((np.full(len(have), q), have, score))
        return tuple(np.concatenate(x) for x in zip(*out))

    return grid_search(index, asked, k, "bigint", n, search)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 65536)) = 0
), s AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
