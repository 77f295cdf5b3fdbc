"""Vectors for search: usable rows, and a grid of index shards by blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool = False, most: float = float("inf")) -> DataFrame:
    """vec_id and embedding (doubles), without null ids and vectors, empty vectors, and
    null or non-finite components or such of `most` or more; nonzero leaves out all-zero vectors too."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('{most}'))")
    return rows.where("exists(embedding, x -> x <> 0)") if nonzero else rows


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of the column's lists, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    length = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), int(length.max(initial=0))))
    out[np.arange(out.shape[1])[None] < length[:, None]] = flat
    return out


#: Most rows of a shard and queries of a block; both stay in a task's memory, so the larger they
#: are the fewer copies travel.
SHARD, BLOCK = 32_768, 32_768
#: Rows below which a shard isn't cut further for the sake of more tasks.
LEAST = 1024


def grid_search(index: DataFrame, queries: DataFrame, k: int, score: str, n: int, search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Each query's k best of the n rows of the index, by blocks of queries against shards of the index.

    index has vec_id and embedding, queries also floor, a number for search.
    search(ids, rows, query_ids, query_rows, floors) returns query ids, row ids and
    scores: at least the shard's k best for each query. A task holds one shard and one
    block, both of bounded size; the shards' lists are merged by rank. Up to BLOCK
    queries the index moves once. Higher scores go first, ties to the smaller vec_id.
    """
    # of different vectors under one query id the least in order asks, in every run
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("embedding", "floor")).alias("q")).select("vec_id", "q.*")
    blocks = max(1, -(-queries.count() // BLOCK))
    tasks = 2 * index.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(tasks // blocks, -(-n // LEAST)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    hashed = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    left = index.select(hashed(shards).alias("shard"), every(blocks).alias("block"), "vec_id", "embedding")
    right = queries.select(every(shards).alias("shard"), hashed(blocks).alias("block"), "vec_id", "embedding", "floor")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64() if score == "bigint" else pa.float64()]
        if not len(rows) or not len(asked):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        x, q = matrix(rows["embedding"]), matrix(asked["embedding"])
        wide = max(x.shape[1], q.shape[1])
        x, q = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (x, q))
        got = search(rows["vec_id"].to_numpy(), x, asked["vec_id"].to_numpy(), q, asked["floor"].to_numpy())
        return pa.Table.from_arrays([pa.array(a, t) for a, t in zip(got, kinds)], names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sampled(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most so many rows, those of the smallest hashes."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "embedding").collect()
    lists = [r["embedding"] for r in found]
    wide = max(map(len, lists), default=1)
    return np.array([r["vec_id"] for r in found], np.int64), np.array([x + [0.0] * (wide - len(x)) for x in lists]).reshape(len(lists), wide)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]
