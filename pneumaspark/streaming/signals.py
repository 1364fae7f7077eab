"""Causal operators on streams of events (recording_id, ts, value).

Zero-phase filters and percentiles of whole recordings look ahead without bound,
so they have no streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = "recording_id"


def sliding_baseline(events: DataFrame, window: str = "7.5 seconds", step: str = "0.2 seconds", percentile: float = 33.0, late: str = "10 seconds") -> DataFrame:
    """(recording_id, start, end, baseline, n): an approximate percentile of each sliding window, once the watermark has passed."""
    grouped = events.withWatermark("ts", late).groupBy(BY, F.window("ts", window, step).alias("w"))
    return grouped.agg(F.percentile_approx("value", percentile / 100, 10000).alias("baseline"), F.count("value").alias("n")).select(BY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "baseline", "n")


def bursts(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(recording_id, start, end, n, peak): sessions of events no further apart than ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy(BY, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(BY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def streaming_breaths(samples: DataFrame) -> DataFrame:
    """(recording_id, start_idx, peak_idx, end_idx) from a stream of (recording_id, idx, value) in order.

    State per recording: the last two samples and the open breath, so it doesn't
    grow; a breath comes out at the valley that ends it.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a_i, a_v, b_i, b_v, valley, peak = state.get if state.exists else (-1, 0.0, -1, 0.0, -1, -1)
        out = []
        for pdf in batches:
            for i, v in pdf.sort_values("idx")[["idx", "value"]].itertuples(index=False):
                if a_i >= 0 and b_i >= 0:
                    if b_v > a_v and b_v > v and valley >= 0 and peak < 0:
                        peak = b_i
                    elif b_v < a_v and b_v < v:
                        if valley >= 0 and peak >= 0:
                            out.append((key[0], valley, peak, b_i))
                        valley, peak = b_i, -1
                a_i, a_v, b_i, b_v = b_i, b_v, int(i), float(v)
        state.update((int(a_i), float(a_v), int(b_i), float(b_v), int(valley), int(peak)))
        yield pd.DataFrame(out, columns=[BY, "start_idx", "peak_idx", "end_idx"])

    return samples.groupBy(BY).applyInPandasWithState(
        step,
        f"{BY} long, start_idx long, peak_idx long, end_idx long",
        "a_i long, a_v double, b_i long, b_v double, valley long, peak long",
        "append",
        "NoTimeout",
    )
