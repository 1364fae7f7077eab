"""Breaths of a stream whose rows come late and out of order, with typed state and event-time timers.

Rows wait in the state of their recording until the watermark has passed them, so whatever order they
come in, they are looked at in the order of idx, and the breaths are those of the whole recording.  A timer
at each batch's latest row wakes the recording up when the watermark is there.  Rows later
than the watermark are dropped: a recording never goes back.

What is kept of a recording: its waiting rows, as many as the watermark's delay holds, and six numbers.
Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BY = "recording_id"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BREATHS = f"{BY} long, start_idx long, peak_idx long, end_idx long"
WAITING = "ms long, idx long, value double"
#: The last two samples, the open breath's valley and peak; -1 where there is none.
TAIL = "a_idx long, a double, b_idx long, b double, valley long, peak long"


class BreathDetector(StatefulProcessor):
    """Valley, peak, valley of strict extrema, each breath at the valley that ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.tail = handle.getValueState("tail", TAIL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, new = None, []
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            ms = pdf["ts"].to_numpy("datetime64[ms]").astype("int64")
            new += [row for row in zip(ms.tolist(), pdf["idx"].tolist(), pdf["value"].tolist(), strict=True) if row[0] >= passed]
        if new:
            self.waiting.appendList(new)
            latest = max(ms for ms, _, _ in new)
            self.handle.registerTimer(latest + 1)
        yield pd.DataFrame([], columns=[BY, "start_idx", "peak_idx", "end_idx"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((idx, value) for ms, idx, value in rows if ms < until)
        rest = [r for r in rows if r[0] >= until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(self.follow(key[0], due), columns=[BY, "start_idx", "peak_idx", "end_idx"])

    def follow(self, recording: int, due: list[tuple[int, float]]) -> list[tuple]:
        """Breaths that end within the samples that are due; the tail goes on from there."""
        a_idx, a, b_idx, b, valley, peak = self.tail.get() if self.tail.exists() else (-1, 0.0, -1, 0.0, -1, -1)
        out = []
        for idx, value in due:
            if idx <= b_idx:  # again, or too late
                continue
            if a_idx >= 0:
                if b > a and b > value and valley >= 0 and peak < 0:
                    peak = b_idx
                elif b < a and b < value:
                    if valley >= 0 and peak >= 0:
                        out.append((recording, valley, peak, b_idx))
                    valley, peak = b_idx, -1
            a_idx, a, b_idx, b = b_idx, b, idx, value
        self.tail.update((a_idx, a, b_idx, b, valley, peak))
        return out


def timed_breaths(samples: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(recording_id, start_idx, peak_idx, end_idx) of a stream (recording_id, ts, idx, value) whose rows are at most ``late`` behind the latest."""
    own = samples.select(F.col(BY).cast("long").alias(BY), "ts", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    grouped = own.withWatermark("ts", late).groupBy(BY)
    return grouped.transformWithStateInPandas(BreathDetector(), BREATHS, "Append", "EventTime")
