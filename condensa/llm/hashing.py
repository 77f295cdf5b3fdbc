"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: rotations learned on a bounded sample so that the signs
lose little (alternating between the signs and the best rotation onto them). A code
is split into substrings, each with an index of its own. If two codes of m substrings
differ in r = m a + b places, then one of the first b + 1 substrings differs in at
most a, or one of the others in at most a - 1; probing all such values of each
substring therefore meets every code within the radius. Those are kept whose whole
code is within it, and their original vectors ranked by inner product.

A substring's index is probed value by value while the values within reach are fewer
than the index has, and else by comparing the values it has.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import gathered
from .common import table
from .vectors import best, grid_search, sampled, usable

#: Vectors the rotations and the radius are learned from, at most.
SAMPLE = 8192
BITS, PART = 256, 64
#: Share of the true neighbours that the radius takes in, as the sample has it.
REACH = 0.96

_BIT = np.uint64(1) << np.arange(PART, dtype=np.uint64)


def _flips(n: int) -> np.ndarray:
    """All substrings with up to n bits set."""
    return np.array([sum(int(_BIT[i]) for i in c) for d in range(n + 1) for c in combinations(range(PART), d)], np.uint64)


class Codes:
    """Rotations with signs, and the Hamming radius."""

    def __init__(self, sample: np.ndarray, k: int, n: int, seed: int = 5):
        """n: rows that the sample stands for. A query's k nearest of n rows are as near as its
        nearest k * len(sample) / n of the sample, one at least."""
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        wide = x.shape[1]
        turns = []
        for _ in range(-(-BITS // wide)):
            turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
            for _ in range(25):
                u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            turns.append(turn)
        self.turn = np.concatenate(turns, 1)[:, :BITS]
        self.radius = BITS
        if len(sample) > k + 1:
            asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
            score = sample[asked] @ sample.T
            score[np.arange(len(asked)), asked] = -np.inf
            near = np.argsort(-score, axis=1)[:, : max(1, round(k * len(sample) / max(n, len(sample))))]
            code = self.of(sample)
            far = np.bitwise_count(code[asked][:, None] ^ code[near]).sum(-1)
            self.radius = int(np.quantile(far, REACH, method="higher"))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """One column of PART bits for each substring."""
        return np.ascontiguousarray(np.packbits((rows - self.mean) @ self.turn > 0, axis=1)).view(np.uint64)


class Index:
    """One index for each substring of the codes of a shard: its values in order, and their rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            value, at, count = np.unique(column[order], return_index=True, return_counts=True)
            self.parts.append((value, at, count, order))

    def met(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that some probe meets: all within the radius, and others."""
        met = np.zeros(len(self.codes), bool)
        a, b = divmod(radius, self.codes.shape[1])
        for t, ((value, at, count, order), own) in enumerate(zip(self.parts, code)):
            reach = min(a if t <= b else a - 1, PART)
            if reach < 0:
                continue
            if sum(comb(PART, d) for d in range(reach + 1)) < len(value):
                wanted = own ^ _flips(reach)
                k = np.minimum(np.searchsorted(value, wanted), len(value) - 1)
                k = k[value[k] == wanted]
            else:
                k = np.flatnonzero(np.bitwise_count(value ^ own) <= reach)
            met[gathered(order, at[k], count[k])] = True
        return np.flatnonzero(met)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from the given one in at most radius places."""
        met = self.met(code, radius)
        return met[np.bitwise_count(self.codes[met] ^ code).sum(1) <= radius]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of the k nearest found of each query.

    The rotations, and the radius that takes in REACH of the true neighbours, are
    learned on at most SAMPLE vectors; every row is indexed. Where a shard has fewer rows
    within the radius than twice its part of k, the radius grows there until it has, so
    that all shards together have k. Rows with the query's vec_id are no candidates; repeated rows are
    candidates each, repeated query ids ask once; ties go to the smaller vec_id. Null
    vec_ids, and vectors null, empty, zero or with null or non-finite components, take
    no part; a shorter vector counts as filled with zeros; an empty table gives no
    rows; other columns are left out.
    """
    rows = usable(vectors, nonzero=True)
    n = rows.count()
    _, sample = sampled(rows, SAMPLE)
    shared = vectors.sparkSession.sparkContext.broadcast(Codes(sample if len(sample) else np.zeros((1, 1)), k, n))

    def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, floors: np.ndarray):
        codes, out = shared.value, []
        wide = max(len(codes.mean), rows.shape[1])
        rows, query_rows = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (rows, query_rows))
        used = len(codes.mean)
        index, asked = Index(codes.of(rows[:, :used])), codes.of(query_rows[:, :used])
        need = min(k, 2 * -(-k * len(rows) // n) + 1)
        for q, code, vector in zip(query_ids, asked, query_rows):
            radius = codes.radius
            while True:
                near = index.within(code, radius)
                near = near[ids[near] != q]
                if len(near) >= need or radius >= BITS:
                    break
                radius = min(BITS, radius + 8)
            score = rows[near] @ vector
            top = best(ids[near], score, k)
            out.append((np.full(len(top), q), ids[near][top], score[top]))
        return tuple(np.concatenate(x) for x in zip(*out))

    asked = usable(queries, nonzero=True).withColumn("floor", F.lit(0))
    return grid_search(rows, asked, k, "double", n, search)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
