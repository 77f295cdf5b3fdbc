"""A cache of results in streaming state: the least recently used goes first, and all go after a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What a row of the output says: whether a call found its result, and which digest had to go for it.
OUTPUT = StructType([StructField("lane", LongType()), StructField("seq", LongType()), StructField("digest", StringType()), StructField("hit", StringType()), StructField("evicted", StringType())])


class LruCache(StatefulProcessor):
    """State of one lane of a cache: when each digest was used last and when it expires, both in the calls' own order and time."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", StructType([StructField("digest", StringType())]), StructType([StructField("used", LongType()), StructField("expires", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        before, out = dict(held), []
        calls = pd.concat(list(rows)).sort_values("seq")
        for seq, digest, now in calls[["seq", "digest", "ms"]].itertuples(index=False):
            entry, evicted = held.pop(digest, None), None
            if hit := entry is not None and entry[1] > now and self.most > 0:
                held[digest] = (seq, entry[1])
            elif self.most > 0:
                if len(held) >= self.most:
                    evicted = min(held, key=lambda d: held[d][0])
                    del held[evicted]
                held[digest] = (seq, now + self.ttl_ms)
            out.append((int(key[0]), int(seq), digest, "hit" if hit else "miss", evicted))
        for digest in before.keys() - held.keys():
            self.entries.removeKey((digest,))
        for digest, value in held.items():
            if before.get(digest) != value:
                self.entries.updateValue((digest,), value)
        # a lane that nobody asks is emptied by the clock
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for entry in list(self.entries.keys()):
            self.entries.removeKey(entry)
        yield pd.DataFrame({c: [] for c in OUTPUT.names}).astype({"lane": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


class Reaper(StatefulProcessor):
    """The state of a job: it fails by the clock if no word comes for a time, unless it has ended."""

    def __init__(self, limit_ms: int, ended: tuple[str, ...]):
        self.limit_ms, self.ended = limit_ms, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", StructType([StructField("status", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("seq")["status"].iloc[-1]
        known = self.status.get()[0] if self.status.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        # what has ended stays so
        now = known if known in self.ended else last
        self.status.update((now,))
        if now not in self.ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield pd.DataFrame({"job": [key[0]], "status": [now]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.status.update(("failed",))
        yield pd.DataFrame({"job": [key[0]], "status": ["failed"]})

    def close(self) -> None:
        pass


def cached(calls: DataFrame, most: int, ttl_ms: int) -> DataFrame:
    """lane, seq, digest, hit and evicted for a stream of calls(lane, seq, digest, ms): whether the result of a call is in its
    lane's cache of at most `most` results, not older than ttl_ms by the calls' own time.

    seq orders the calls of a lane (different ones); a hit is used again, a miss is put in, for which the least recently
    used result goes. Lanes are independent, so the cache is split as the calls are. State survives a restart from
    the stream's checkpoint; a lane without calls for ttl_ms of the clock is emptied. Needs the RocksDB state store."""
    return calls.groupBy("lane").transformWithStateInPandas(LruCache(most, ttl_ms), OUTPUT, "Append", "ProcessingTime")


def reaped(jobs: DataFrame, limit_ms: int, ended: tuple[str, ...] = ("done", "failed", "cancelled")) -> DataFrame:
    """job and status for a stream of jobs(job, seq, status): each change as it comes, and `failed` for a job
    that says nothing for limit_ms of the clock before it has ended. Needs the RocksDB state store."""
    schema = StructType([StructField("job", jobs.schema["job"].dataType), StructField("status", StringType())])
    return jobs.groupBy("job").transformWithStateInPandas(Reaper(limit_ms, ended), schema, "Update", "ProcessingTime")
