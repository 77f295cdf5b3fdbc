"""Paraphrases inside a text: parts that share most of their words with an earlier one, of which the shorter stays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Least words of a part that is compared, the similarity of its pairs of words by mode, and the share of words of the
#: smaller part that the other has; least tokens and copies for the pass after chunks.
WORDS, SIMILARITY, OVERLAP = 7, {"conservative": 0.80, "balanced": 0.75, "maximum": 0.70}, 0.5
POST_TOKENS, POST_COPIES = 1200, 2
#: Hash functions of a signature, and how many of them make a band.
PERMUTATIONS, BAND = 128, 4
_WORD = re.compile("[a-z0-9]+")
_A, _B = (np.random.default_rng(7).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the distinct pairs of neighbouring words."""
    return np.unique(np.array([xxhash.xxh64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:])], np.uint64))


def bands(hashes: np.ndarray) -> list[tuple]:
    """Bands of a MinHash signature. Two sets of similarity s share one with probability 1 - (1 - s ** BAND) ** (PERMUTATIONS / BAND):
    0.9999 at 0.7."""
    with np.errstate(over="ignore"):
        mixed = hashes[:, None] * _A[None] + _B[None]
        mixed ^= mixed >> np.uint64(29)
        low = (mixed * np.uint64(0xFF51AFD7ED558CCD)).min(0).reshape(-1, BAND)
    return [(k, row.tobytes()) for k, row in enumerate(low)]


class Kept:
    """The parts kept so far; a new one is compared with those that share a band with it."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.buckets: dict[tuple, list[int]] = {}
        self.facts: dict[int, tuple[np.ndarray, set[str]]] = {}

    def met(self, words: list[str], hashes: np.ndarray, mine: list[tuple]) -> int | None:
        """The first part kept that this one paraphrases."""
        own = set(words)
        for i in sorted({i for b in mine for i in self.buckets.get(b, ())}):
            other, theirs = self.facts[i]
            both = len(np.intersect1d(hashes, other, assume_unique=True))
            if both >= self.threshold * (len(hashes) + len(other) - both) and len(own & theirs) >= OVERLAP * min(len(own), len(theirs)):
                return i
        return None

    def put(self, i: int, words: list[str], hashes: np.ndarray, mine: list[tuple]) -> None:
        """Part i is as given from now on; what it was before isn't met any more."""
        if i in self.facts:
            for b in bands(self.facts[i][0]):
                self.buckets[b].remove(i)
        self.facts[i] = (hashes, set(words))
        for b in mine:
            self.buckets.setdefault(b, []).append(i)


def chosen(parts: list[str], stays: list[bool], threshold: float) -> list[str | None]:
    """What becomes of each part: itself, a shorter paraphrase that comes later, or None if it goes.

    From the first part to the last: one that paraphrases a kept part goes, but a shorter one takes that part's
    place. Parts that must stay, and those of fewer than WORDS words, are neither compared nor met."""
    kept, out = Kept(threshold), list(parts)
    for i, part in enumerate(parts):
        words = _WORD.findall(part.lower())
        if stays[i] or len(words) < WORDS:
            continue
        hashes = shingles(words)
        mine = bands(hashes)
        at = kept.met(words, hashes, mine)
        if at is None:
            kept.put(i, words, hashes, mine)
            continue
        out[i] = None
        if len(part) < len(out[at]):
            out[at] = part
            kept.put(at, words, hashes, mine)
    return out


def _folded(rows: DataFrame, threshold: float, key: str, joint: str, good: Callable[[int], bool]) -> DataFrame:
    """key, text and n_removed of rows of key, text, parts and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(1).to_pylist(), []
            for i, (parts, stays) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                left = chosen(parts, stays, threshold) if parts else []
                n = sum(x is None for x in left)
                gone.append(n if good(n) else 0)
                if gone[-1]:
                    texts[i] = joint.join(x for x in left if x is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], [key, "text", "n_removed"])

    return rows.select(key, "text", "parts", "stays").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text string, n_removed bigint")


def without_paraphrases(docs: DataFrame, mode: str = "balanced", key: str = "doc_id") -> DataFrame:
    """key, text and n_removed (sentences): texts in which sentences that paraphrase an earlier one have gone.

    Sentences with a directive or constraint cue stay. What is left is joined by spaces; a text that loses nothing, and null,
    stays as it is. A text's sentences meet in banded buckets, so its work grows with them and their paraphrases."""
    sentences = T.sentences(F.col("text"))
    rows = docs.select(key, "text", sentences.alias("parts")).withColumn("stays", F.transform("parts", T.has_cue))
    return _folded(rows, SIMILARITY[mode], key, " ", lambda n: n > 0)


def after_chunks(docs: DataFrame, mode: str = "balanced", key: str = "doc_id") -> DataFrame:
    """key, text and n_removed (paragraphs): the pass over texts put together from chunks.

    Only texts of POST_TOKENS tokens or more that aren't code or JSON lose paragraphs, and only if POST_COPIES or more would go."""
    rows = docs.select(key, "text", F.when((T.n_tokens(F.col("text")) >= POST_TOKENS) & ~T.content_class(F.col("text")).isin("code", "json"), T.paragraphs(F.col("text"))).alias("parts"))
    rows = rows.withColumn("stays", F.transform("parts", lambda p: p.rlike(r"__[A-Za-z0-9_]+_[0-9]+__")))
    return _folded(rows, SIMILARITY[mode], key, "\n\n", lambda n: n >= POST_COPIES)
