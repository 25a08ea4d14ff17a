"""Streaming forms: sliding detection windows, merged alarms, late and repeated statements."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding(stream: DataFrame, time: str, keys: list[str], width: str = "600 seconds", every: str = "300 seconds", late: str = "1 hour") -> DataFrame:
    """(window, keys, n, mean, top) of each sliding detection window."""
    w = F.window(time, width, every)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))


def threshold_alarms(stream: DataFrame, time: str, keys: list[str], hot: Column, gap: str = "601 seconds", late: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): hot samples no further apart than ``gap`` are one alarm."""
    session = F.session_window(time, gap)
    merged = stream.where(hot).withWatermark(time, late).groupBy(session, *keys).agg(F.count(F.lit(1)).alias("n"))
    return merged.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(stream: DataFrame, time: str, identity: list[str], late: str = "1 hour") -> DataFrame:
    """Statements once each, whatever they are read again by; state is dropped after ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def bounded_seen(stream: DataFrame, group: str, identity: str, time_ms: str, most: int = 500, expiry_ms: int = 3_600_000) -> DataFrame:
    """(group, identity, time): rows whose identity is not among the last ``most`` of its group that are younger than ``expiry_ms``.

    The state of a group is its latest identities with their times, ``most`` at most; older ones
    leave first, and a repeated one counts as seen when it first came.
    """
    schema = f"{group} {dict(stream.dtypes)[group]}, identity string, time_ms long"

    def step(key, batches, state):
        ids, times = state.get if state.exists else ([], [])
        buffer = dict(zip(ids, times))
        oldest = [(t, i) for i, t in buffer.items()]
        heapq.heapify(oldest)
        for pdf in batches:
            fresh = []
            for i, t in sorted(zip(pdf[identity].astype(str), pdf[time_ms]), key=lambda x: (x[1], x[0])):
                while oldest and oldest[0][0] <= t - expiry_ms:
                    seen_at, gone = heapq.heappop(oldest)
                    if buffer.get(gone) == seen_at:
                        del buffer[gone]
                if i not in buffer:
                    buffer[i] = int(t)
                    heapq.heappush(oldest, (int(t), i))
                    fresh.append((key[0], i, int(t)))
                    while len(buffer) > most:
                        del buffer[next(iter(buffer))]
            yield pd.DataFrame(fresh, columns=[group, "identity", "time_ms"])
        state.update((list(buffer), list(buffer.values())))

    return stream.groupBy(group).applyInPandasWithState(step, schema, "ids array<string>, times array<long>", "append", "NoTimeout")


def periodic(stream: DataFrame, task: Callable[[DataFrame, int], None], every: str, checkpoint: str) -> StreamingQuery:
    """A task on each interval's rows; a failed interval is run again from the checkpoint."""
    return stream.writeStream.foreachBatch(task).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
