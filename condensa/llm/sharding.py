"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows of equal text are one atomic group. Groups are ordered by a hash of their
text, after the few large ones, and the order is cut into contiguous shards so that the largest shard is as
small as any such cut allows: binary search finds the smallest capacity for which
greedy filling needs no more shards than there are, and the cuts are made there.

The groups stay on the executors. The driver sees sums over ranges of the order,
a bounded number at a time: cuts between ranges bound the capacity from above, and
only the ranges in which a cut can still fall are divided further, until each of
them is one group.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, n_bytes, table

#: Ranges into which the order, or a range of it that may hold a cut, is divided.
FAN = 4096
#: Groups above 1 / LARGE of a shard's part go first, the largest foremost, so that they
#: don't leave a shard short; there are at most shards x LARGE of them.
LARGE = 64
_BITS = 62


def _prefix(sums: list[int]) -> list[int]:
    out = [0]
    for x in sums:
        out.append(out[-1] + x)
    return out


def _cuts(prefix: list[int], capacity: int) -> list[int]:
    """Greedy filling: the index after each shard's last item."""
    at, cuts = 0, []
    while at < len(prefix) - 1:
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(at)
    return cuts


def smallest_capacity(sums: list[int], shards: int) -> int:
    """The least capacity at which greedy filling needs at most `shards` shards."""
    prefix = _prefix(sums)
    low, high = max([0, *sums, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if len(_cuts(prefix, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _range_sums(groups: DataFrame, ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int, int, int]]:
    """(first key, width, bytes, groups) of the pieces of width keys, a power of two, of ranges of keys."""
    wanted = F.lit(False)
    for low, high in ranges:
        wanted = wanted | F.col("key").between(low, high - 1)
    piece = F.shiftright("key", width.bit_length() - 1)
    rows = groups.where(wanted).groupBy(piece.alias("piece")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("key")).collect()
    return sorted((r["key"], width, int(r["bytes"]), int(r["n"])) for r in rows)


def _open_spans(items: list[tuple[int, int, int, int]], shards: int, least: int, most: int) -> list[tuple[int, int]]:
    """First and last of the items in which a cut can fall for a capacity from least to
    most, for each cut that can fall inside an item of several groups."""
    prefix = _prefix([x[2] for x in items])
    low = high = 0
    found: list[tuple[int, int]] = []
    for _ in range(shards):
        low = prefix[bisect_right(prefix, low + least) - 1]
        high = min(high + most, prefix[-1])
        last = min(bisect_right(prefix, high) - 1, len(items) - 1)
        if items[last][3] == 1 and high < prefix[-1]:
            high = prefix[last]
        first = bisect_right(prefix, low) - 1
        if first >= len(items):
            break
        several = [k for k in range(first, last + 1) if items[k][3] > 1 and prefix[k] < high]
        if several and found and several[0] <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], several[-1]))
        elif several:
            found.append((several[0], several[-1]))
        if low >= prefix[-1]:
            break
    return found


def find_cuts(groups: DataFrame, first: list[int], shards: int) -> list[int]:
    """The keys at which shards 1, 2, ... begin, for groups(key, bytes) with distinct keys,
    which follow groups of first[k] bytes, whose keys are k - len(first)."""
    width = 1 << (_BITS - FAN.bit_length() + 1)
    items = [(k - len(first), 1, x, 1) for k, x in enumerate(first)] + _range_sums(groups, [(0, 1 << _BITS)], width)
    while items:
        sums = [x[2] for x in items]
        capacity = smallest_capacity(sums, shards)
        least = max([-(-sum(sums) // shards), *(x[2] for x in items if x[3] == 1)])
        spans = _open_spans(items, shards, least, capacity)
        if not spans:
            return [items[k][0] for k in _cuts(_prefix(sums), capacity)[:-1]]
        ranges = [(items[a][0] // items[a][1] * items[a][1], (items[b][0] // items[b][1] + 1) * items[b][1]) for a, b in spans]
        aim = sum(b - a for a, b in ranges) // (16 * FAN)
        width = min(width >> 1, 1 << aim.bit_length()) or 1
        inside = {k for a, b in spans for k in range(a, b + 1)}
        items = sorted([x for k, x in enumerate(items) if k not in inside] + _range_sums(groups, ranges, width))
    return []


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the text's place in the order."""
    text = F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n"))
    return docs.select(
        F.col("doc_id").cast("long"),
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _BITS).alias("key"),
    )


def _shard(key: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for cut in cuts:
        out = out + (key >= cut).cast("int")
    return out


#: Rows that one lane of a shard numbers, about.
LANE = 100_000


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of each row of docs, under the law `bytes`.

    A row's size is its text's UTF-8 bytes plus 1; null texts are equal to each
    other, distinct from the empty text. Equal texts share a shard, so one text that
    holds more than its shard's part makes that shard larger, and others equal.
    Texts are told apart by a hash of 62 bits; two that collide stay together.
    Slots count from 0 without gaps in each shard, over lanes of hashed doc_ids, so
    that a large group is numbered in many tasks. Repeated rows each have a slot,
    in any order among themselves; null doc_ids too. An empty table gives no rows.
    Other columns are left out.
    """
    rows = keyed(docs)
    groups = checkpoint(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    part, lanes = total // (shards * LARGE), n // (shards * LANE) + 1
    groups = groups.drop("n")
    large = groups.where(F.col("bytes") > part).orderBy(F.desc("bytes"), "key").collect() if part else []
    schema = "key bigint, first bigint"
    named = docs.sparkSession.createDataFrame([(r["key"], k - len(large)) for k, r in enumerate(large)], schema)
    cuts = find_cuts(groups.join(F.broadcast(named), "key", "left_anti"), [int(r["bytes"]) for r in large], shards)
    rows = rows.join(F.broadcast(named), "key", "left").withColumn("at", F.coalesce("first", "key"))
    placed = rows.select("doc_id", "size", "text_crc32", _shard(F.col("at"), cuts).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(lanes)).cast("int").alias("lane"))
    counts = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    lane_order = "partition by shard order by lane rows between unbounded preceding and 1 preceding"
    offsets = counts.select("shard", "lane", F.expr(f"coalesce(sum(n) over ({lane_order}), 0)").alias("before"))  # dealt out as the rows are, so only these move
    numbered = placed.withColumn("place", F.expr("row_number() over (partition by shard, lane order by doc_id, text_crc32, size) - 1"))
    return numbered.join(offsets, ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
