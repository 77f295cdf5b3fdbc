"""Language identification by multilingual mixture inference.

Every language has a table of byte n-gram probabilities. A document is a mixture
of languages that deals out its words: expectation-maximisation estimates the
proportions from the words' n-gram likelihoods, and the set of languages kept is
the one with the best penalised likelihood, each further language costing half
the logarithm of the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import release, table

#: Documents a language is learned from, about: those with the smallest hashes.
SAMPLE = 2000
#: Slots of the table of n-grams; n-grams are bytes of lower-case words with a space at each end.
SLOTS, N = 1 << 15, 3
_NOT_LETTER = regex.compile(r"\P{L}+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words, and the word of each n-gram."""
    text = b"  " + b"  ".join([w.encode("utf-8", "replace") for w in words]) + b"  "
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    slot = np.zeros(len(data) - N + 1, np.uint32)
    for k in range(N):
        slot = (slot * np.uint32(0x01000193)) ^ data[k : k + len(slot)]
    slot = (slot * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    length = np.array([len(w.encode("utf-8", "replace")) for w in words], np.int64)
    own = np.repeat(np.arange(len(words)), length)
    at = np.repeat(1 + np.cumsum(length + 2) - (length + 2), length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return slot[at], own


def normal(piece: str) -> str:
    """Its letters, in lower case, other runs becoming one space."""
    return piece.lower() if piece.isalpha() else _NOT_LETTER.sub(" ", piece.lower()).strip()


def hash_limit(sample: int, n: int) -> int:
    """The 63-bit hash up to which about `sample` of n rows lie."""
    return (2**63 - 1) * min(sample, n) // n


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each slot in each, from about `sample`
    documents a language with a text and a lang whose crc32(doc_id as text) mod 4 is not 2.

    Counts are summed before they reach the driver, which gets a table of a fixed size.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where("id is not null and text is not null and lang is not null and crc32(cast(id as binary)) % 4 <> 2")
    most = {r["lang"]: hash_limit(sample, r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(most)
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32)
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), SLOTS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot, _ = grams([w for w in map(normal, text.split()) if w])
                sums[langs.index(lang)] += np.bincount(slot, minlength=SLOTS)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], ["lang", "slot", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang bigint, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    sums = np.full((SLOTS, len(langs)), 0.05)
    sums[counted["slot"], counted["lang"]] += counted["n"]
    return langs, np.log(sums / sums.sum(0)).astype(np.float32)


class Mixture:
    """Infers the languages of texts; keeps a bounded memory of words' likelihoods."""

    KEEP = 100_000
    #: A document's proportions have settled when none moves by more in a round; the rounds only guard the loop.
    SETTLED, ROUNDS = 1e-3, 1000

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)), np.float32)
        self.is_word = np.zeros(0, bool)

    def _learn(self, fresh: list[str]) -> None:
        words = [normal(x) for x in fresh]
        slot, own = grams(words)
        like = np.stack([np.bincount(own, self.logp[slot, k], len(words)) for k in range(len(self.langs))], 1)
        self.table = np.concatenate((self.table, like.astype(np.float32)))
        self.is_word = np.concatenate((self.is_word, np.array([bool(w) for w in words], bool)))

    def _rows(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > self.KEEP:
            self._forget()
        seen, fresh, out, first = self.seen, [], [], len(self.seen)
        for text in texts:
            words = text.split()
            try:
                out.append([seen[w] for w in words])
            except KeyError:
                for w in words:
                    if w not in seen:
                        seen[w] = first + len(fresh)
                        fresh.append(w)
                out.append([seen[w] for w in words])
        if fresh:
            self._learn(fresh)
        return [(i := np.array(x, np.int64))[self.is_word[i]] for x in out]

    def _em(self, like: np.ndarray, doc: np.ndarray, at: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions once they have settled, and the log likelihood of each document; a share of 0 stays 0."""
        top = like.max(1, keepdims=True)
        p = np.exp(np.maximum(like - top, -60))
        count = np.diff(np.append(at, len(doc)))
        share = share.copy()
        live, q, own, begin = np.arange(len(at)), p, doc, at  # documents still moving, and their words
        for _ in range(self.ROUNDS):
            part = q * share[own]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            new = np.add.reduceat(part, begin, axis=0) / count[live][:, None]
            moving = np.abs(new - share[live]).max(1) > self.SETTLED
            share[live] = new
            if not moving.any():
                break
            if not moving.all():
                word = np.repeat(moving, count[live])
                live, q, own = live[moving], q[word], own[word]
                begin = np.cumsum(count[live]) - count[live]
        total = np.add.reduceat(np.log(np.maximum((p * share[doc]).sum(1), 1e-30)) + top[:, 0], at)
        return share, total

    def infer(self, texts: list[str]) -> list[tuple[str, float, list[str]]]:
        """(language, its proportion, the set of languages) of each text; `und` without letters."""
        rows = self._rows(texts) if self.langs else [np.zeros(0, np.int64)] * len(texts)
        out: list[tuple[str, float, list[str]]] = [("und", 0.0, [])] * len(texts)
        full = [k for k, r in enumerate(rows) if len(r)]
        if not full:
            return out
        n = np.array([len(rows[k]) for k in full])
        at, doc = np.cumsum(n) - n, np.repeat(np.arange(len(full)), n)
        like, width = self.table[np.concatenate([rows[k] for k in full])], len(self.langs)
        share, full_total = self._em(like, doc, at, np.full((len(full), width), 1 / width, np.float32))
        order = np.argsort(-share, axis=1, kind="stable")
        single = np.add.reduceat(like, at, axis=0, dtype=np.float64)
        best = np.take_along_axis(single, order[:, :1], 1)[:, 0]
        chosen = np.zeros_like(share)
        np.put_along_axis(chosen, order[:, :1], 1, 1)
        for size in range(2, width + 1):
            # all languages together bound what any set of them reaches; the one unit is for proportions still moving
            cost = 0.5 * (size - 1) * np.log(n) + (size - 1) * 4
            more = np.flatnonzero(full_total + 1 - cost > best)
            if not len(more):
                break
            word = np.isin(doc, more)
            d = np.searchsorted(more, doc[word])
            start = np.zeros((len(more), width), np.float32)
            np.put_along_axis(start, order[more, :size], 1 / size, 1)
            part, total = self._em(like[word], d, np.cumsum(n[more]) - n[more], start)
            score = total - cost[more]
            wins = score > best[more]
            best[more[wins]] = score[wins]
            chosen[more[wins]] = part[wins]
        for k, p in zip(full, chosen):
            top = int(p.argmax())
            out[k] = (self.langs[top], float(min(1.0, max(0.0, p[top]))), [self.langs[j] for j in np.flatnonzero(p > 0)])
        return out


_CHUNK = 1 << 20


def predicted(docs: DataFrame, carry: Column, sample: int = SAMPLE) -> DataFrame:
    """carry (a struct of columns of docs), lang_pred, score and langs of each row of docs.

    A text that carry has travels in it only, and texts become Python strings a chunk at a time."""
    langs, logp = learn(docs, sample)
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))
    rows = docs.select(carry.alias("carry"))
    own = [i for i, f in enumerate(rows.schema["carry"].dataType.fields) if f.name == "text"][:1]
    if not own:
        rows = docs.select(carry.alias("carry"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(*model.value)
        for batch in batches:
            text = batch.column(0).field(own[0]) if own else batch.column(1)
            end = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + _CHUNK, "right")))
                got = mixture.infer([x or "" for x in text.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    ["carry", "lang_pred", "score", "langs"],
                )
                a = b
        release()

    schema = StructType([rows.schema["carry"], *StructType.fromDDL("lang_pred string, score double, langs array<string>").fields])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and langs (the language set) of each row of docs.

    Null, empty and letterless texts are `und` with score 0, as is every text when
    no language could be learned. Texts are read whole. Repeated rows each give a
    row; a null doc_id isn't held out and nothing is learned from it; an empty
    table gives no rows; other columns are left out. Ties go to the first language
    by name. Prediction has no shuffle.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    carry = F.struct(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))
    return predicted(docs, carry, sample).select("carry.doc_id", "carry.held_out", "lang_pred", "score", "langs")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, in whose text a language was found with at least
    that proportion; null, empty and letterless texts go, as do all if no language could be
    learned. Equal rows and null doc_ids are judged each by the text; an empty table stays
    empty; other columns may have any names."""
    return predicted(docs, F.struct("*")).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("carry.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
