"""Micro-batch sinks, rate limits and windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def micro_batches(rows: DataFrame, path: str, checkpoint: str, every: str = "5 seconds") -> DataStreamWriter:
    """Appends what has come to parquet files; the checkpoint makes each batch count once.

    A batch closes by time; how many rows one takes is the source's setting (maxFilesPerTrigger,
    maxOffsetsPerTrigger), which stands for the flush at a number of rows."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def windowed_usage(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls a key and window, closed once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("calls"))


def accepted(times: np.ndarray, recent: np.ndarray, most: int, seconds: float) -> np.ndarray:
    """Which of the sorted times are accepted, after the accepted ones in recent: those with fewer than
    `most` accepted in the seconds before them.

    A time is accepted if the accepted one `most` before it is too old; the window lasts
    (now - seconds, now]."""
    taken = list(recent)
    out = np.zeros(len(times), bool)
    for k, now in enumerate(times.tolist()):
        if most and (len(taken) < most or taken[-most] <= now - seconds):
            out[k] = True
            taken.append(now)
    return out


def rate_limited(events: DataFrame, key: str, most: int, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """key, ts, accepted: a call is accepted if fewer than `most` accepted ones lie in the
    seconds before it. State is the last `most` accepted times at the most; a key is forgotten
    once the watermark, `late` behind the newest call, has passed its window. Calls behind the
    watermark are left out."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(frames).sort_values("ts")
        times = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6
        good = accepted(times, recent, most, seconds)
        last = np.concatenate((recent, times[good]))[-most:] if most else recent[:0]
        state.update(([float(x) for x in last if x > times[-1] - seconds],))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"], "accepted": good})

    kind = dict(events.dtypes)[key]
    return events.select(F.col(key).alias("key"), "ts").withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, accepted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_priors(telemetry: DataFrame, ts: str, keys: list[str], value: str, ttl: str = "5 minutes") -> DataFrame:
    """Means of the value a key in windows of the ttl's length, each final once its watermark has passed:
    what a cache that expires by age is filled from."""
    return telemetry.withWatermark(ts, ttl).groupBy(F.window(ts, ttl), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
