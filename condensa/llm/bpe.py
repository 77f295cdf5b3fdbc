"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged by a segment tree over its byte
positions: a leaf holds the rank of the pair that starts there, an inner node
the smaller of its children, ties to the left, so the root is the next merge.
A merge changes at most two pairs, each a walk from a leaf to the root. Trees of
one height are kept as the rows of one array and advance together, so a step of
the loop makes one merge in every word that still has one; a few long words are merged
one after another, each in a tree of its own, as there is little to advance together.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import release, table

_NONE = np.int64(2**62)
#: A space beside other white space, and the place before a space that stands alone.
_TOUCHING = regex.compile(r"\s | \s")
_ALONE = regex.compile(r"(?<=\S)(?= \S)")


class Bpe:
    """One vocabulary of ranks, and a bounded memory of pieces of text already encoded."""

    #: Pieces kept; beyond them the memory starts anew. Only speed depends on it.
    KEEP = 100_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.by_space = pattern.endswith(r"|\s+(?!\S)|\s+") and " ?" in pattern
        self.n = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # plain arrays, so that a worker doesn't keep the room of hundreds of thousands of objects
        pairs = array("q", (x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]] * self.n + ranks[t[k:]], r)))
        key, rank = np.frombuffer(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(key)
        self.key, self.rank = key[order], rank[order]
        self.token_len = np.zeros(self.n, np.int64)
        for t, r in ranks.items():
            self.token_len[r] = len(t)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.at, self.len, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.n + b
        k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[k] == want, self.rank[k], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of up to one power of two of bytes, one after another, and their counts."""
        size = 1 << max(1, (max(map(len, words)) - 1).bit_length())
        n = len(words)
        length = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8)
        live = (np.arange(size)[None] < length[:, None]).ravel()
        token = np.where(live, self.byte[flat], -1)
        after = np.tile(np.arange(1, size + 1), n)
        before = np.tile(np.arange(-1, size - 1), n)
        tree = np.full((n, 2 * size), _NONE)
        i = np.flatnonzero(live[1:] & (np.arange(1, n * size) % size > 0))
        rank = self.pair_rank(token[i], token[i + 1])
        tree[i // size, size + i % size] = np.where(rank < _NONE, rank * size + i % size, _NONE)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        tree = tree.ravel()

        def put(r: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            root, k, at = r * (2 * size), pos + size, size
            tree[root + k] = value
            while at > 1:
                at >>= 1
                other = tree[root + (k ^ 1)]
                k = k >> 1
                value = np.minimum(value, other)
                tree[root + k] = value

        def pair_at(r: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self.pair_rank(token[r * size + left], token[r * size + right])
            return np.where(rank < _NONE, rank * size + left, _NONE)

        r = np.flatnonzero(tree[1 :: 2 * size] < _NONE)
        while len(r):
            best = tree[r * (2 * size) + 1]
            p, here = best % size, r * size
            q = after[here + p]
            token[here + p] = best // size
            token[here + q] = -1
            far = after[here + q]
            after[here + p] = far
            more = far < length[r]
            value = np.full(len(r), _NONE)
            if more.any():
                rm, pm, fm = r[more], p[more], far[more]
                before[rm * size + fm] = pm
                value[more] = pair_at(rm, pm, fm)
            put(r, q, np.full(len(r), _NONE))
            put(r, p, value)
            near = before[here + p]
            has = near >= 0
            if has.any():
                rh, nh = r[has], near[has]
                put(rh, nh, pair_at(rh, nh, p[has]))
            r = r[tree[r * (2 * size) + 1] < _NONE]
        kept = token >= 0
        return token[kept].astype(np.int32), kept.reshape(n, size).sum(1)

    def merge_one(self, word: bytes) -> np.ndarray:
        """The ids of one word; a tree node holds rank * size + place."""
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        none, own = int(_NONE), self.byte[np.frombuffer(word, np.uint8)]
        rank = self.pair_rank(own[:-1], own[1:])
        level = np.full(size, _NONE)
        level[: n - 1] = np.where(rank < _NONE, rank * size + np.arange(n - 1), _NONE)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        token, after, before = own.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        key, last = self.key, len(self.key) - 1

        def put(place: int, value: int) -> None:
            k = place + size
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other
                if tree[k] == value:
                    break
                tree[k] = value

        def pair_at(left: int, right: int) -> int:
            want = token[left] * self.n + token[right]
            k = min(int(key.searchsorted(want)), last)
            return int(self.rank[k]) * size + left if key[k] == want else none

        while (best := tree[1]) < none:
            p = best % size
            q = after[p]
            token[p], token[q] = best // size, -1
            far = after[p] = after[q]
            put(q, none)
            if far < n:
                before[far] = p
                put(p, pair_at(p, far))
            else:
                put(p, none)
            if before[p] >= 0:
                put(before[p], pair_at(before[p], p))
        return np.array([t for t in token if t >= 0], np.int32)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin and how many they are."""
        raw = [w.encode("utf-8") for w in words]
        height = np.array([max(1, (len(w) - 1).bit_length()) for w in raw])
        at, length, parts, total = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), [], 0
        for h in np.unique(height).tolist():
            ks = np.flatnonzero(height == h)
            block = max(1, (1 << 17) >> h)
            for b in range(0, len(ks), block):
                part = ks[b : b + block]
                if h > 5 and len(part) < 16:
                    found = [self.merge_one(raw[k]) for k in part.tolist()]
                    ids, n = np.concatenate(found), np.array([len(x) for x in found])
                else:
                    ids, n = self.merge([raw[k] for k in part.tolist()])
                at[part] = total + np.cumsum(n) - n
                length[part] = n
                total += len(ids)
                parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), at, length

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces, each some matches of the pattern, to the memory."""
        word: dict[str, int] = {}
        found = [self.find(x) for x in pieces]
        index = np.array([word.setdefault(w, len(word)) for ws in found for w in ws], np.int64)
        ids, at, length = self.merged(list(word))
        end = np.cumsum(length[index])
        last = np.cumsum([len(ws) for ws in found])
        ends = np.where(last > 0, end[last - 1], 0) if len(end) else np.zeros(len(pieces), np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        self.at = np.concatenate((self.at, len(self.ids) + starts))
        self.len = np.concatenate((self.len, ends - starts))
        self.ids = np.concatenate((self.ids, gathered(ids, at[index], length[index])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > self.KEEP:
            self._forget()
        seen, fresh, index, first = self.seen, [], [], len(self.seen)
        for text in texts:
            pieces = self.pieces(text)
            try:
                index.append([seen[x] for x in pieces])
            except KeyError:
                for x in pieces:
                    if x not in seen:
                        seen[x] = first + len(fresh)
                        fresh.append(x)
                index.append([seen[x] for x in pieces])
        if fresh:
            self.learn(fresh)
        return [gathered(self.ids, self.at[i], self.len[i]) for i in (np.array(k, np.int64) for k in index)]

    def pieces(self, text: str) -> list[str]:
        """Cuts of text that no match of the pattern crosses: before single spaces with other
        characters than white space, of any kind, on both sides; these can only go to what follows."""
        if not self.by_space:
            return self.find(text)
        if _TOUCHING.search(text):
            return _ALONE.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


def gathered(values: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices values[at : at + length], one after another."""
    step = at - (np.cumsum(length) - length)
    return values[np.repeat(step, length) + np.arange(int(length.sum()))]


_cache: dict[tuple[str, str], Bpe] = {}


def tokenizer(path: str, pattern: str) -> Bpe:
    """The worker's own copy, read where the task runs."""
    if (path, pattern) not in _cache:
        _cache[path, pattern] = Bpe(path, pattern)
    return _cache[path, pattern]


#: Characters of text handled at once.
_CHUNK = 1 << 20


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids.

    path is the rank file, which every executor can read. Null and empty texts
    have no ids, and the digests of nothing. Repeated rows and doc_ids each give
    a row, null doc_ids too; an empty table gives none; other columns are left
    out. There is no shuffle: a task holds a chunk of texts and its bounded
    memory of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            at = 0
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK, "right")))
                part = batch.slice(at, end - at)
                ids = bpe.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at = end
        release()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
