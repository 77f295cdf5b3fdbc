"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences is hashed, runs are joined over the whole
table, and a sentence goes where any run over it also stands earlier: in a document
with a smaller id, or earlier in the same document. A longer run repeats just where all runs
of two in it repeat, so runs of two sentences stand for all; a text of one sentence is
one run.

A sentence is text up to a full stop, exclamation or question mark or line end (ASCII, full-width
and some other scripts' marks), with the marks and blank lines that follow. A passage
pasted into running text continues a sentence, and another goes on behind it, so sentences are cut
into clauses at commas, semicolons and colons: the rest of a sentence from any of its clauses on counts as
a sentence before the next one, and its beginning up to any clause as one behind the one before, if both together
have TORN_WORDS words, or TORN_BYTES bytes for scripts without spaces. Where a sentence is long, the shortest runs of its clauses that have WORDS words or BYTES bytes
are hashed too. Runs compare without the marks and white space at their parts' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, checkpoint, mix, packed, table, twinned, utf8

#: Least clauses, words and bytes of a run of clauses inside a sentence, and how many times as long the sentence is at least.
RUN, WORDS, BYTES, LONG = 2, 16, 120, 2
#: Least words or bytes of a part of a sentence and the sentence beside it. Runs of whole sentences have no least size.
TORN_WORDS, TORN_BYTES = 12, 90
#: The marks that end a sentence, and those that only end a clause.
STOPS, COMMAS = "\n.!?。！？।؟", ",;:，、；：،"
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


#: Bytes of texts that are cut and hashed together.
TOGETHER = 1 << 20
_ONE = {}
for _name, _marks in (("stop", STOPS), ("mark", STOPS + COMMAS)):
    _ONE[_name] = np.zeros(256, bool)
    _ONE[_name][[ord(c) for c in _marks if ord(c) < 128]] = True


def _marked(data: np.ndarray, name: str, marks: str, high: np.ndarray) -> np.ndarray:
    """Which bytes belong to the marks. high: where bytes begin a longer code."""
    mark = _ONE[name][data]
    for code in (c.encode() for c in marks if ord(c) > 127) if len(high) else ():
        at = high[data[high] == code[0]]
        at = at[at + len(code) <= len(data)]
        for i in range(1, len(code)):
            at = at[data[at + i] == code[i]]
        for i in range(len(code)):
            mark[at + i] = True
    return mark


class Clauses:
    """The clauses of several texts, one text after the other.

    start (in its text, 0 for the first), first and last (begin and end of what is compared), words, closes (whether the
    sentence ends with it) and text (its number); own is where each text's clauses begin, and their number at the end."""

    def __init__(self, texts: list[bytes]):
        # a line end behind each text ends its last sentence
        self.data = data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        offset = np.concatenate(([0], np.cumsum(size)))
        high = np.flatnonzero(data > 0xC1)
        stop, mark = _marked(data, "stop", STOPS, high), _marked(data, "mark", STOPS + COMMAS, high)
        gap = _GAP[data]
        solid = ~(mark | gap)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], mark, [True])).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        place = np.flatnonzero(solid)
        low, high = np.searchsorted(place, begin), np.searchsorted(place, end)
        real = high > low
        begin, end, low, high = begin[real], end[real], low[real], high[real]
        self.first, self.last = place[low], place[high - 1] + 1
        heads = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
        self.words = np.searchsorted(heads, end) - np.searchsorted(heads, begin)
        at = np.flatnonzero(stop)
        self.closes = np.ones(len(begin), bool)
        self.closes[:-1] = np.searchsorted(at, begin[1:]) > np.searchsorted(at, end[:-1])
        self.text = np.searchsorted(offset, self.first, "right") - 1
        self.own = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.start = begin - offset[self.text]
        self.start[self.own[:-1][self.own[:-1] < self.own[1:]]] = 0
        self.upto = [np.concatenate(([0], np.cumsum(x))) for x in (self.words, self.last - self.first)]

    def enough(self, first: np.ndarray, end: np.ndarray, words: int, size: int) -> np.ndarray:
        """Whether the clauses from first to before end have so many words or bytes."""
        w, b = self.upto
        return (w[end] - w[first] >= words) | (b[end] - b[first] >= size)


def inside_runs(c: Clauses, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First clause and the one after the last of the shortest run of enough words or bytes from each clause of a long sentence on
    that goes on so far; begin and stop are the first and last clause of each clause's sentence."""
    w, b = c.upto
    at = np.flatnonzero(c.enough(begin, stop + 1, LONG * WORDS, LONG * BYTES))
    end = np.maximum(np.minimum(np.searchsorted(w, w[at] + WORDS), np.searchsorted(b, b[at] + BYTES)), at + RUN)
    fits = end <= stop[at] + 1
    return at[fits], end[fits]


def _joined(parts: list[np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and 32 bits of runs of parts, from the parts' hashes."""
    a, b = np.full(len(parts[0]), salt, np.uint64), np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + part
        b = (b ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (part ^ np.uint64(0xD6E8FEB86659FD93))
    return mix(a).view(np.int64), mix(b).view(np.int64).astype(np.int32)


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each run, its text, and its first clause there and number of clauses as first * 65536 + number; a run of that
    many or more goes to the text's end and has the number 0."""
    c = Clauses(texts)
    if not len(c.first):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, ends = Hashes(c.data).of, np.flatnonzero(c.closes)
    begins, text = np.concatenate(([0], ends[:-1] + 1)), c.text[ends]
    sentence = np.repeat(np.arange(len(ends)), ends + 1 - begins)
    begin, stop, whole = begins[sentence], ends[sentence], of(c.first[begins], c.last[ends])
    follows, clause = np.concatenate((text[1:] == text[:-1], [False])), np.arange(len(sentence))
    # the rest of a sentence and the next one; the one before and the beginning of a sentence; a sentence alone; clauses
    ahead = clause[follows[sentence]]
    ahead = ahead[(ahead == begin[ahead]) | c.enough(ahead, ends[sentence[ahead] + 1] + 1, TORN_WORDS, TORN_BYTES)]
    back = clause[~c.closes & (begin > 0) & follows[sentence - 1]]
    back = back[c.enough(begins[sentence[back] - 1], back + 1, TORN_WORDS, TORN_BYTES)]
    alone = np.flatnonzero(~follows & np.concatenate(([True], ~follows[:-1])))
    inner, upto = inside_runs(c, begin, stop)
    keys = [
        _joined([of(c.first[ahead], c.last[stop[ahead]]), whole[sentence[ahead] + 1]], 2),
        _joined([whole[sentence[back] - 1], of(c.first[begin[back]], c.last[back])], 2),
        _joined([whole[alone]], 1),
        _joined([of(c.first[inner], c.last[upto - 1])], 3),
    ]
    first = np.concatenate((ahead, begins[sentence[back] - 1], begins[alone], inner))
    end = np.concatenate((ends[sentence[ahead] + 1] + 1, back + 1, ends[alone] + 1, upto))
    text, size = c.text[first], end - first
    return np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys]), text, (first - c.own[text] << 16) + np.where(size < 1 << 16, size, 0)


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are cut together."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > TOGETHER:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """doc_id, twin and span (first clause and number) of each run that stands earlier too, for
    rows of doc_id, text and twin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, twins = utf8(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, end in _together([len(t) for t in texts]):
                a, b, text, span = runs(texts[first:end])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[first:end][text]), pa.array(twins[first:end][text] << 44 | span)], ["a", "b", "doc_id", "place"])

    spans = rows.where("doc_id is not null and text is not null").select("doc_id", "text", "twin").mapInArrow(run, "a bigint, b int, doc_id bigint, place bigint")
    # written, so that both sides of the join are dealt out for it, and a hot side can be split
    origin = spans.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("origin")).where("n > 1").select("a", "b", "origin")
    again = spans.join(checkpoint(origin), ["a", "b"]).where("struct(doc_id, place) <> origin")
    return again.selectExpr("doc_id", "place >> 44 as twin", "place & 17592186044415 as span")


def remove_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences of which nothing is left) and the text left, of each row of docs.

    Null and empty texts, and texts of marks alone, have no sentences and stay. Equal rows
    are one document and stay alike; different texts under one doc_id are documents in
    the order of their hashes; rows with a null doc_id take no part and stay whole.
    Copies keep only the first's sentences. Texts are compared whole, however long; an
    empty table gives no rows; other columns are left out. The runs are counted before
    they meet, so one that holds a third of all rows is summed in many tasks, and the
    join back leaves its rows to be split.
    """
    rows = twinned(docs.select(F.col("doc_id").cast("long"), "text"))
    removed = repeated_spans(rows).groupBy("doc_id", "twin").agg(F.collect_set("span").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packs, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for low, high in _together([zstandard.frame_content_size(p) if p else 0 for p in packs]):
                texts = [None if p is None else unpack(p) for p in packs[low:high]]
                c = Clauses([t or b"" for t in texts])
                cut = np.zeros(len(c.first), bool)
                for i, spans in enumerate(found[low:high]):
                    for span in spans or ():
                        cut[c.own[i] + (span >> 16) : c.own[i] + (span >> 16) + (span & 65535) if span & 65535 else c.own[i + 1]] = True
                stop = np.flatnonzero(c.closes) + 1
                kept = np.concatenate(([0], np.cumsum(~cut)))
                gone = np.diff(kept[np.concatenate(([0], stop))]) == 0
                upto = np.searchsorted(c.text[stop - 1], np.arange(len(texts) + 1))
                n_gone = np.concatenate(([0], np.cumsum(gone)))[upto]
                left = []
                for i, text in enumerate(texts):
                    mine = slice(c.own[i], c.own[i + 1])
                    if text is not None and cut[mine].any():
                        bounds = np.append(c.start[mine], len(text)).tolist()
                        text = b"".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~cut[mine]).tolist())
                    left.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(np.diff(upto)), pa.array(np.diff(n_gone)), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    out = packed(rows).join(removed, ["doc_id", "twin"], "left").select("doc_id", "packed", "spans")
    return out.mapInArrow(run, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spans(table(spark, sf_dir, "documents"))


_S, _M = STOPS.replace("\n", r"\n"), (STOPS + COMMAS).replace("\n", r"\n")
_FRAME = "PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING"
_LONG = " ".join(f"WHEN count(*) OVER ({_FRAME.format(k - 1)}) = {k} AND (sum(w) OVER ({_FRAME.format(k - 1)}) >= {WORDS} OR sum(b) OVER ({_FRAME.format(k - 1)}) >= {BYTES}) THEN {k}" for k in range(RUN, WORDS + 1))
#: A text without marks and white space at its ends.
_CORE = f"regexp_replace(regexp_replace({{0}}, '[{_M}\\s]+$', ''), '^[{_M}\\s]+', '')"

SQL = rf"""
WITH c AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^{_M}]*[^{_M}\s][^{_M}]*[{_M}]*(?:\s*[{_M}]+)*') parts FROM documents
), u AS (
  SELECT doc_id, len(parts) n, unnest(range(1, len(parts) + 1)) i, unnest(parts) part, unnest(list_transform(parts, lambda x, i: i = len(parts) OR regexp_matches(x, '[{_S}]'))) stop FROM c
), v AS (
  SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) j FROM u
), x AS (
  SELECT doc_id, j, i, stop, len(regexp_extract_all({_CORE.format("part")}, '[^\x20\x09-\x0D]+')) w, strlen({_CORE.format("part")}) b,
    {_CORE.format("string_agg(part, '') OVER (PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")} rest,
    {_CORE.format("string_agg(part, '') OVER (PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} head FROM v
), y AS (
  SELECT *, CASE WHEN sum(w) OVER (PARTITION BY doc_id, j) >= {LONG * WORDS} OR sum(b) OVER (PARTITION BY doc_id, j) >= {LONG * BYTES} THEN CASE {_LONG} END END k FROM x
), e AS (
  SELECT doc_id, j, min(i) i, max(i) z, arg_min(rest, i) s, sum(w) w, sum(b) b, count(*) OVER (PARTITION BY doc_id) m FROM x GROUP BY doc_id, j
), l AS (
  SELECT *, sum(w) OVER r w1, sum(b) OVER r b1, sum(w) OVER h w2, sum(b) OVER h b2 FROM x WINDOW r AS (PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), h AS (PARTITION BY doc_id, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), a AS (
  SELECT x.doc_id, x.i, e.z - x.i + 1 k, 'p' || x.rest || e'\x01' || e.s g FROM l x JOIN e ON e.doc_id = x.doc_id AND e.j = x.j + 1 JOIN e o ON o.doc_id = x.doc_id AND o.j = x.j WHERE x.i = o.i OR x.w1 + e.w >= {TORN_WORDS} OR x.b1 + e.b >= {TORN_BYTES}
  UNION ALL
  SELECT x.doc_id, e.i, x.i - e.i + 1, 'p' || e.s || e'\x01' || x.head FROM l x JOIN e ON e.doc_id = x.doc_id AND e.j = x.j - 1 WHERE NOT x.stop AND (x.w2 + e.w >= {TORN_WORDS} OR x.b2 + e.b >= {TORN_BYTES})
  UNION ALL
  SELECT doc_id, i, z - i + 1, 'w' || s FROM e WHERE m = 1
  UNION ALL
  SELECT y.doc_id, i, k, 'c' || {_CORE.format("array_to_string(parts[i : i + k - 1], '')")} FROM y JOIN c ON c.doc_id = y.doc_id WHERE k IS NOT NULL
), s AS (
  SELECT doc_id, i, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, i, k) place FROM a
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + k)))) gone FROM s WHERE place > 1 GROUP BY doc_id
), q AS (
  SELECT v.doc_id, j, bool_and(coalesce(list_contains(gone, i), false)) lost FROM v LEFT JOIN g ON g.doc_id = v.doc_id GROUP BY v.doc_id, j
), t AS (
  SELECT doc_id, count(*) n_sentences, CAST(sum(CAST(lost AS INT)) AS BIGINT) n_removed FROM q GROUP BY 1
)
SELECT c.doc_id, coalesce(n_sentences, 0) n_sentences, coalesce(n_removed, 0) n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i)), ''), '') END AS text
FROM c LEFT JOIN g ON c.doc_id = g.doc_id LEFT JOIN t ON t.doc_id = c.doc_id
"""
