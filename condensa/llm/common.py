"""Shared pieces: reading tables, checkpoints, and vectorised hashing of byte strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the separators of words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; an error where the session
    names none, as a folder of the driver's own can't be read elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def twinned(docs: DataFrame) -> DataFrame:
    """Adds twin: 0, or the number of a row's text among the different texts of its doc_id.

    doc_id and twin name a document: equal rows are one, different texts under one
    doc_id several, in a repeatable order. Only ids and digests are shuffled, unless
    there are such ids.
    """
    digest = F.xxhash64("text")
    ids = docs.where("doc_id is not null").select("doc_id", digest.alias("digest"))
    several = checkpoint(ids.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high"))
    if several.isEmpty():
        # 0 for all, but no literal: joins are then dealt out by both columns, as groups by both are
        return docs.withColumn("twin", F.coalesce(F.col("doc_id").bitwiseAND(0), F.lit(0)).cast("long"))
    texts = ids.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    numbers = texts.withColumn("number", F.expr("row_number() over (partition by doc_id order by digest) - 1L"))
    rows = docs.withColumn("digest", digest).join(numbers, ["doc_id", "digest"], "left").withColumn("twin", F.coalesce("number", F.lit(0)).cast("long"))
    return rows.select(*docs.columns, "twin")


#: Bytes of text that become Python objects at once.
CHUNK = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most CHUNK bytes of column `at`, or of one row: a worker's
    memory follows the slice, not Spark's batch of 10,000 texts."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + CHUNK, "right")))
            yield batch.slice(a, b - a)
            a = b


def packed(rows: DataFrame) -> DataFrame:
    """rows with text compressed, as packed; null stays null."""
    at, names = rows.columns.index("text"), ["packed" if c == "text" else c for c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches, at):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else pack(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    kinds = [StructType.fromDDL("packed binary")[0] if f.name == "text" else f for f in rows.schema.fields]
    return rows.mapInArrow(run, StructType(kinds))


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the crc32 of a string's UTF-8 bytes, four bits at a time; what 16 table values would hold is computed."""
    bits = f"list_transform(range(0, length(hex({x}))), lambda i: instr('0123456789ABCDEF', substr(hex({x}), 2 * (i // 2) + 2 - i % 2, 1)) - 1)"
    step = "xor(c >> 4, list_reduce([xor(c, b) & 15, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384)))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295)"


def release() -> None:
    """Gives unused memory back at the end of a task, Arrow's and the C library's, as its Python worker goes on to others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's strings as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash's base and of its inverse modulo 2**64."""
    for k, base in enumerate((_B, _B_INV)):
        have = _powers[k]
        while len(have) <= n:
            step = have[-1:] * base
            have = np.concatenate((have, have * step))
        _powers[k] = have
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole of an unsigned 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Random value for each byte, so that the polynomial doesn't see plain codes.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _B)


class Hashes:
    """Hashes of any substring of some bytes, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Of each substring of n bytes."""
        if len(self.prefix) <= n:
            return np.zeros(0, np.uint64)
        k = len(self.prefix) - n
        return mix((self.prefix[n:] - self.prefix[:k]) * self.inverse[:k] + np.uint64(n))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and the starts and ends of the words in them."""
    data = np.frombuffer(text, np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return data, edge[0::2], edge[1::2]


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a shorter text is one run; no words, none."""
    data, start, end = words_of(text)
    if not len(start):
        return np.zeros(0, np.uint64)
    word = Hashes(data).of(start, end)
    m = min(n, len(word))
    run = np.zeros(len(word) - m + 1, np.uint64)
    for i in range(m):
        run = run * _B + word[i : len(word) - m + 1 + i]
    return np.unique(mix(run + np.uint64(m)))
