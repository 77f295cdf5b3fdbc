"""Suffix-array deduplication of repeated byte strings.

The suffixes of all texts that can share LENGTH bytes are dealt into buckets: every
window of LENGTH bytes goes by its minimiser, the smallest hash of the substrings of
ANCHOR bytes in it, so equal windows meet. Consecutive windows with one minimiser
travel as one string. Minimisers that occur once are dropped before any text moves.

A task builds one enhanced suffix array (order by prefix doubling, longest common
prefixes) over the strings of its buckets. Scanning it with a stack gives the tree of
common-prefix intervals. An interval of depth LENGTH or more whose suffixes follow
different bytes is a maximal repeat: its members are all the occurrences of one
string that no byte to the left could extend. All but its first occurrence are
copies; together the maximal repeats cover every repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Hashes, checkpoint, packed, release, sliced, table, twinned, utf8

LENGTH, ANCHOR = 100, 24
#: Strings of a minimiser above which its windows go by their own hash instead.
HOT = 2000
#: Bytes of text for which one suffix array is built.
_CHUNK = 1 << 19
#: Bits of a place's start and number of windows; the document's twin is above them.
_PLACE = 40
_START = (1 << _PLACE) - 1


def windows(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows whose minimiser, the
    leftmost of equals, is at one place."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = Hashes(data).windows(anchor)
    width = length - anchor + 1
    # the upper bits of the hash, then the place: the least is the leftmost of equals
    low = np.uint64((1 << max(24, len(value).bit_length())) - 1)
    least, have = (value & ~low) | np.arange(len(value), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return value[(least[first] & low).astype(np.int64)].view(np.int64), first, np.diff(np.append(first, n))


class SuffixArray:
    """Order of the suffixes at some places of a text, and their common prefixes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, until: np.ndarray):
        """until[p]: the end of the string that p is in; no prefix reads beyond it."""
        n = len(text)
        self.text, self.until = text, until
        padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
        left = until - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(7):  # values up to 256 in nine bits
            key = (key << np.uint64(9)) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
        self.ranks = [(7, self._ranked(key))]
        span = 7
        while span < left.max(initial=0):
            rank = self.ranks[-1][1]
            far = np.minimum(np.arange(n) + span, n - 1)
            second = np.where(left > span, rank[far] + 1, 0)
            self.ranks.append((2 * span, self._ranked(rank.astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64))))
            span *= 2
        rank = self.ranks[-1][1]
        self.order = starts[np.argsort(rank[starts], kind="stable")]
        self.lcp = self._common(self.order[:-1], self.order[1:])

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1], dtype=np.int32)))
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes: by the ranks of halving spans, then, where LENGTH may be met, by bytes."""
        top = len(self.until) - 1
        total = np.zeros(len(a), np.int64)
        for span, rank in reversed(self.ranks):
            pa_, pb = np.minimum(a + total, top), np.minimum(b + total, top)
            same = (a + total < self.until[a]) & (b + total < self.until[b]) & (rank[pa_] == rank[pb])
            same &= (a + total + span <= self.until[a]) & (b + total + span <= self.until[b])
            total += np.where(same, span, 0)
        more = np.flatnonzero(total > LENGTH - 7)
        for _ in range(6):
            x, y = a[more] + total[more], b[more] + total[more]
            more = more[(x < self.until[a[more]]) & (y < self.until[b[more]]) & (self.text[np.minimum(x, top)] == self.text[np.minimum(y, top)])]
            total[more] += 1
        return total


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of the suffix order whose suffixes share depth bytes,
    least or more, after different bytes. before: the byte in front of each suffix of the order,
    or a value of its own where there is none."""
    deep = lcp >= least
    edge = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    differs = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        if differs[b] == differs[a]:
            continue  # one byte stands before all of them: a longer repeat, one byte to the left
        stack = [(int(lcp[a]), a)]
        for k in range(a + 1, b + 1):
            depth = int(lcp[k]) if k < b else 0
            left = k
            while stack and stack[-1][0] > depth:
                top, left = stack.pop()
                if differs[k] != differs[left]:
                    yield top, left, k
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def _copies(texts: list[bytes], doc: np.ndarray, start: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(length, occurrences as places in the chunk, first occurrence) of the maximal repeats of some strings."""
    size = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(texts)), size)
    until = (begin + size)[own]
    place = np.arange(len(text))
    starts = place[until - place >= least]
    array = SuffixArray(text, starts, until)
    order = array.order
    before = np.where(order > begin[own[order]], text[np.maximum(order - 1, 0)].astype(np.int64), -1 - order)
    at = start[own[order]] + order - begin[own[order]]
    whose = doc[own[order]]
    for depth, a, b in maximal_repeats(order, array.lcp, before, least):
        members = slice(a, b + 1)
        first = a + int(np.lexsort((at[members], whose[members]))[0])
        yield depth, order[members], int(order[first])


def _first_windows(strings: list[tuple[bytes, int, int]], least: int) -> Iterator[tuple[int, int, int]]:
    """(doc_id, first, n) runs of windows that no earlier equal window precedes, from distinct
    strings (text, doc_id, start) of some buckets, by one suffix array."""
    texts = [x[0] for x in strings]
    doc, start = (np.array([x[k] for x in strings], np.int64) for k in (1, 2))
    size = np.array([len(t) for t in texts])
    fresh = np.ones(int(size.sum()), bool)
    for depth, members, first in _copies(texts, doc, start, least):
        for p in members[members != first].tolist():
            fresh[p : p + depth - least + 1] = False
    begin = np.cumsum(size) - size
    edge = np.repeat(size - least + 1, size) > np.arange(int(size.sum())) - np.repeat(begin, size)
    change = np.flatnonzero(np.diff(np.concatenate(([0], (fresh & edge).view(np.int8), [0])))).reshape(-1, 2)
    own = np.searchsorted(begin, change[:, 0], "right") - 1
    return zip(doc[own].tolist(), (start[own] + change[:, 0] - begin[own]).tolist(), (change[:, 1] - change[:, 0]).tolist())


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, minimiser, place (twin, start and n as bits) and hot: the runs of windows whose minimiser
    occurs again, for rows of doc_id, text and twin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [windows(np.frombuffer(t, np.uint8)) for t in utf8(batch.column(1))]
            count = [len(f[0]) for f in found]
            ids, twin = (np.repeat(batch.column(k).to_numpy(), count) for k in (0, 2))
            m, start, n = (np.concatenate([f[k] for f in found]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids), pa.array((twin << _PLACE) | (start << 8) | n)], ["minimiser", "doc_id", "place"])
        release()

    runs = docs.mapInArrow(run, "minimiser bigint, doc_id bigint, place bigint")
    # written, so that both sides of the join are dealt out for it, and a hot side can be split
    again = checkpoint(runs.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1").select("minimiser", F.expr(f"n > {HOT}").alias("hot")))
    return runs.join(again, "minimiser")


def strings_of(rows: DataFrame, first_only: bool) -> DataFrame:
    """bucket, text, doc_id and start (twin and place as bits) of the strings of rows of doc_id, packed, runs,
    copy and twin; whole copies have none. Of equal strings of a bucket, first_only leaves the first of
    every thousand documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
                every: list[tuple[int, bytes, int, int]] = []
                lists = part.column(2)
                at = np.concatenate(([0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))))
                flat = lists.flatten()
                place, minimiser = (flat.field(k).to_numpy() for k in (0, 1))
                hot = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
                for k, (doc, text, copy) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 3)))):
                    if copy or at[k] == at[k + 1]:
                        continue
                    text, own = unpack(text), slice(at[k], at[k + 1])
                    twin = int(place[at[k]]) >> _PLACE << _PLACE - 8
                    p = place[own][~hot[own]] & _START
                    found = [(b, text[s : s + n], s) for b, s, n in zip(minimiser[own][~hot[own]].tolist(), (p >> 8).tolist(), ((p & 255) + LENGTH - 1).tolist())]
                    if hot[own].any():
                        hashes = Hashes(np.frombuffer(text, np.uint8)).windows(LENGTH).view(np.int64)
                        for q in (place[own][hot[own]] & _START).tolist():
                            found += [(int(hashes[s]), text[s : s + LENGTH], s) for s in range(q >> 8, (q >> 8) + (q & 255))]
                    for bucket, string, s in found:
                        if not first_only:
                            every.append((bucket, string, doc, twin + s))
                            continue
                        old = earliest.get((bucket, string))
                        if old is None or (doc, twin + s) < old:
                            earliest[bucket, string] = (doc, twin + s)
                every += [(*k, *v) for k, v in earliest.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in every], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "text", "doc_id", "start"])

    return rows.mapInArrow(cut, "bucket bigint, text binary, doc_id bigint, start bigint")


def groups_of(occurrences: dict[bytes, list[tuple[int, int]]], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences as (document, place)) of the maximal repeats of some distinct strings, each
    with the occurrences of its first byte."""
    texts = list(occurrences)
    for text, places in occurrences.items():
        if len(places) > 1:
            yield len(text), sorted(places)
    if len(texts) < 2 and (not texts or len(texts[0]) <= least):
        return
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    for depth, members, _ in _copies(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64), least):
        own = np.searchsorted(begin, members, "right") - 1
        offset = members - begin[own]
        if depth == size[own[0]] and (own == own[0]).all():
            continue
        yield depth, sorted((doc, start + int(o)) for k, o in zip(own.tolist(), offset) for doc, start in occurrences[texts[k]])


def repeat_groups(docs: DataFrame) -> DataFrame:
    """group, length, doc_id, twin and start: every occurrence (in bytes) of each maximal repeat.

    A group is the occurrences of one string of LENGTH bytes or more that differ in the byte
    before or after it, as far as the strings of its bucket reach (176 bytes at most; single
    windows where a minimiser has more than HOT strings): longer repeats are chains of
    overlapping groups. A group is named by a number. Equal rows are one document, texts
    under LENGTH bytes and null doc_ids have no part; an empty table gives no rows. Windows
    that stand in very many documents stream through their task, so that no group is
    collected."""
    named = twinned(docs.select(F.col("doc_id").cast("long"), "text")).where("doc_id is not null and text is not null").distinct()
    by_doc = repeated(named).groupBy("doc_id", F.shiftright("place", _PLACE).alias("twin")).agg(F.collect_set(F.struct("place", "minimiser", "hot")).alias("runs"))
    rows = packed(named).join(by_doc, ["doc_id", "twin"]).select("doc_id", "packed", "runs", F.lit(None).cast("boolean").alias("copy"), "twin")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        held: dict[bytes, list[tuple[int, int]]] = {}
        now: int | None = None
        text_now: bytes | None = None
        streaming = False

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["group", "length", "doc_id", "start"])
            out.clear()
            return batch

        def closed() -> None:
            for k, (length, places) in enumerate(groups_of(held, LENGTH)):
                out.extend(((now * 31 + k) % (1 << 63), length, doc, start) for doc, start in places)
            held.clear()

        for batch in batches:
            for bucket, text, doc, start in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket != now:
                    closed()
                    now, text_now, streaming = bucket, None, False
                if streaming and text == text_now:
                    out.append((now * 31 % (1 << 63), LENGTH, doc, start))
                    continue
                places = held.setdefault(text, [])
                places.append((doc, start))
                if len(text) == LENGTH and len(held) == 1 and len(places) > HOT:
                    # one window over and over: its group is all there is, so it needn't be held
                    out.extend((now * 31 % (1 << 63), LENGTH, *x) for x in places)
                    held.clear()
                    streaming, text_now = True, text
                if len(out) > 50_000:
                    yield flushed()
        closed()
        yield flushed()

    strings = strings_of(rows, False).repartition("bucket").sortWithinPartitions("bucket", "text")
    found = strings.mapInArrow(scan, "group bigint, length bigint, doc_id bigint, start bigint")
    bits = _PLACE - 8
    return found.select("group", "length", "doc_id", F.shiftright("start", bits).alias("twin"), F.col("start").bitwiseAND((1 << bits) - 1).alias("start"))


def removed_windows(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id, packed (text), runs and firsts, the windows met again and those of them that are the
    first of their kind, each as start * 256 + number, copy, and carry if given."""
    named = twinned(docs.select(F.col("doc_id").cast("long"), "text", *([] if carry is None else [carry.alias("carry")])))
    usable = named.where("doc_id is not null and text is not null").select("doc_id", "text", "twin")
    same = usable.select("doc_id", "twin", F.xxhash64("text").alias("a"), F.md5(F.col("text").cast("binary")).alias("b"))
    # of equal texts the first stays and the others go whole: their strings needn't travel
    original = checkpoint(same.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "twin")).alias("original")).where("n > 1").drop("n"))
    copies = same.join(original, ["a", "b"]).where("struct(doc_id, twin) <> original").select("doc_id", "twin").distinct().withColumn("copy", F.lit(True))
    # sets, since equal rows of one document give the same runs
    by_doc = repeated(usable).groupBy("doc_id", F.shiftright("place", _PLACE).alias("twin")).agg(F.collect_set(F.struct("place", "minimiser", "hot")).alias("runs"))
    document = ["doc_id", "twin"]
    rows = packed(named).join(by_doc, document, "left").join(copies, document, "left").select("doc_id", "packed", "runs", "copy", "twin", *([] if carry is None else ["carry"]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        wait: list[tuple[bytes, int, int]] = []
        group: dict[bytes, tuple[int, int]] = {}
        held, now = 0, None

        def flushed() -> pa.RecordBatch:
            doc, start, n = (np.array([x[k] for x in out], np.int64) for k in range(3))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start << 8 | n)], ["doc_id", "place"])

        def closed() -> None:
            """The strings of a bucket: one has only first windows, several meet in a suffix array."""
            nonlocal held
            if len(group) == 1:
                (text, (doc, start)), = group.items()
                out.append((doc, start, len(text) - LENGTH + 1))
            else:
                wait.extend((t, *v) for t, v in group.items())
                held += sum(map(len, group))
            group.clear()
            if held > _CHUNK:
                out.extend(_first_windows(wait, LENGTH))
                wait.clear()
                held = 0

        for batch in batches:
            for bucket, text, doc, start in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket != now:
                    if group:
                        closed()
                    now = bucket
                old = group.get(text)
                if old is None or (doc, start) < old:
                    group[text] = (doc, start)
            if len(out) > 50_000:
                yield flushed()
        if group:
            closed()
        if wait:
            out.extend(_first_windows(wait, LENGTH))
        yield flushed()
        release()

    firsts = strings_of(rows, True).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scan, "doc_id bigint, place bigint")
    firsts = firsts.groupBy("doc_id", F.shiftright("place", _PLACE).alias("twin")).agg(F.collect_set(F.col("place").bitwiseAND(_START)).alias("firsts"))
    starts = F.transform("runs", lambda r: r["place"].bitwiseAND(_START))
    # the texts stay where the first join dealt them out by document
    return rows.join(firsts, document, "left").select("doc_id", "packed", starts.alias("runs"), "firsts", "copy", *rows.columns[5:])


def covered(size: int, runs: list[int] | None, firsts: list[int] | None, copy: bool | None, length: int = LENGTH) -> np.ndarray:
    """Which of size bytes lie in a window that is met again and not the first of its kind; of a
    whole copy all do, if it has a window."""
    if copy:
        return np.full(size, size >= length)
    change = np.zeros(size + 1, np.int64)
    if runs:
        for places, sign in ((runs, 1), (firsts or [], -1)):
            p = np.array(places, np.int64)
            np.add.at(change, p >> 8, sign)
            np.add.at(change, (p >> 8) + (p & 255), -sign)
        bad = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        change[:] = 0
        np.add.at(change, bad, 1)
        np.add.at(change, np.minimum(bad + length, size), -1)
    return np.cumsum(change[:-1]) > 0


def _spans(gone: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each row of docs.

    spans are the maximal removed runs as start and end in bytes. Null and empty texts
    have no bytes; texts under LENGTH bytes lose none. Equal rows are one document, so
    they stay alike; different texts under one doc_id are documents in the order of
    their hashes; rows with a null doc_id take no part and stay whole. Of equal windows
    the first, by document and place, stays. An empty table gives no rows; other
    columns are left out; texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size, lost, count, digest, spans = [], [], [], [], []
            for text, runs, firsts, copy in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                data = np.frombuffer(unpack(text) if text is not None else b"", np.uint8)
                gone = covered(len(data), runs, firsts, copy)
                found = _spans(gone)
                size.append(len(data))
                lost.append(int(gone.sum()))
                count.append(len(found))
                digest.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in found.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return removed_windows(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, with texts without the repeated bytes.

    A character of which a byte goes, goes whole; n_chars, if there is one, is counted
    anew. A text of which nothing but white space is left goes with its row; a text
    that was null, empty or blank before stays. Equal rows stay alike, rows with a null
    doc_id whole; an empty table stays empty. Other columns may have any names.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    carry = F.struct(*[F.col(f"`{c}`") for c in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, 1):
            texts: list[str | None] = []
            lost = []
            for text, runs, firsts, copy in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                data = np.frombuffer(unpack(text), np.uint8) if text is not None else np.zeros(0, np.uint8)
                gone = covered(len(data), runs, firsts, copy)
                left = data[~gone].tobytes().decode("utf-8", "ignore") if text is not None else None
                texts.append(left)
                lost.append(bool(gone.any()) and not (left or "").strip())
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(texts, pa.string()), pa.array(lost, pa.bool_())], ["carry", "text", "lost"])
        release()

    rows = removed_windows(docs, carry)
    schema = StructType([rows.schema["carry"], *StructType.fromDDL("text string, lost boolean").fields])
    out = rows.mapInArrow(run, schema).where("not lost")
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"carry.`{c}`") for c in docs.columns]
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")


SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) t FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(t, 2 * i + 1, 200)) s FROM (SELECT doc_id, t, unnest(range(0, greatest(0, len(t) // 2 - 99))) i FROM h)
), b AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) place FROM w) WHERE place > 1
), e AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END fresh FROM b
), r AS (
  SELECT doc_id, min(i) a, max(i) + 100 z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) g FROM e) GROUP BY doc_id, g
), k AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) p FROM r
), x AS (
  SELECT h.doc_id, any_value(t) t, count(a) n, coalesce(sum(z - a), 0) lost, coalesce(max(z), 0) tail,
    coalesce(string_agg(substr(t, 2 * p + 1, 2 * (a - p)), '' ORDER BY a), '') head
  FROM h LEFT JOIN k ON h.doc_id = k.doc_id GROUP BY h.doc_id
)
SELECT doc_id, CAST(len(t) // 2 AS BIGINT) n_bytes, CAST(lost AS BIGINT) n_removed, CAST(n AS BIGINT) n_spans, sha256(unhex(head || substr(t, 2 * tail + 1))) kept_sha256 FROM x
"""
