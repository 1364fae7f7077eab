"""Synthetic recordings: a breathing waveform, lung frames and derived channels, as Spark expressions.

The few random numbers (one set per breath) come from a seeded generator on the
driver; samples are made on the executors from ``spark.range``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pneumaspark.operators.rangejoin import in_intervals


def breath_table(spark: SparkSession, duration: float, rate: float = 14.0, jitter: float = 2.0, seed: int = 42) -> DataFrame:
    """(recording_id, breath_no, start_t, end_t, peak_share, amplitude): jittered breaths that fill the duration."""
    r, rows, t = np.random.default_rng(seed), [], 0.0
    while t < duration:
        length = 60 / max(4.0, rate + jitter * r.standard_normal())
        rows.append((0, len(rows), t, t + length, float(np.clip(0.4 + 0.03 * r.standard_normal(), 0.2, 0.7)), float(max(0.2, 1 + 0.1 * r.standard_normal()))))
        t += length
    return spark.createDataFrame(rows, "recording_id long, breath_no long, start_t double, end_t double, peak_share double, amplitude double")


def respiratory_signal(spark: SparkSession, duration: float = 60.0, fs: float = 20.0, heart_rate: float = 75.0, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """samples: raised-cosine breaths, two heart harmonics, Gaussian noise and a slow drift."""
    t = (F.col("id") / F.lit(fs)).alias("t")
    base = spark.range(int(duration * fs)).select(F.lit(0).cast("long").alias("recording_id"), F.col("id").alias("idx"), t)
    placed = in_intervals(base, breath_table(spark, duration, seed=seed), "start_t", "end_t", "t", bucket=4.0, closed=False)
    x = (F.col("t") - F.col("start_t")) / (F.col("end_t") - F.col("start_t"))
    rise = 0.5 - 0.5 * F.cos(math.pi * x / F.col("peak_share"))
    fall = 0.5 + 0.5 * F.cos(math.pi * (x - F.col("peak_share")) / (1 - F.col("peak_share")))
    heart = 2 * math.pi * heart_rate / 60 * F.col("t")
    value = F.col("amplitude") * F.when(x < F.col("peak_share"), rise).otherwise(fall) + 0.05 * F.sin(heart) + 0.02 * F.sin(2 * heart) + noise * F.randn(seed) + 0.02 * F.sin(2 * math.pi * F.col("t") / duration)
    return placed.select("recording_id", "idx", "t", value.alias("value"))


def lung_template(rows: int = 32, cols: int = 32) -> np.ndarray:
    """Two Gaussian lungs less a penalty at the centre, clipped, the greatest value 1."""
    y, x = np.mgrid[0:rows, 0:cols] / np.array([rows - 1, cols - 1])[:, None, None]
    lung = sum(np.exp(-(((x - c) / 0.15) ** 2 + ((y - 0.5) / 0.25) ** 2)) for c in (0.3, 0.7)) - 0.3 * np.exp(-(((x - 0.5) / 0.08) ** 2 + ((y - 0.5) / 0.3) ** 2))
    lung = np.clip(lung, 0, None)
    return lung / lung.max()


def to_frames(samples: DataFrame, template: np.ndarray) -> DataFrame:
    """frames (recording_id, frame_idx, t, pixels): (value - least value) times the template."""
    low = F.min("value").over(Window.partitionBy("recording_id"))
    grid = F.array(*[F.lit(float(v)) for v in template.ravel()])
    return samples.withColumn("_v", F.col("value") - low).select("recording_id", F.col("idx").alias("frame_idx"), "t", F.transform(grid, lambda g: g * F.col("_v")).alias("pixels"))


def ventilator_channels(samples: DataFrame) -> DataFrame:
    """Adds volume (the value), flow (central difference over time) and pressure (5 + 10 volume + 2 flow)."""
    w = Window.partitionBy("recording_id").orderBy("idx")
    ahead, behind = (lambda c: F.coalesce(F.lead(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(w), F.col(c)))
    flow = F.try_divide(ahead("value") - behind("value"), ahead("t") - behind("t"))
    return samples.withColumn("volume", F.col("value")).withColumn("flow", flow).withColumn("pressure", 5 + 10 * F.col("volume") + 2 * F.col("flow"))


def drift(kind: str, t: Column, amplitude: float, period: float = 60.0) -> Column:
    """A sinusoidal, linear or constant drift."""
    made = {"sinusoidal": amplitude * F.sin(2 * math.pi * t / period), "linear": amplitude * t / period, "constant": F.lit(amplitude)}
    return made[kind]


def shift_samples(samples: DataFrame, n: int) -> DataFrame:
    """Shift values by n samples and crop: sample i takes the value of i - n, without filling; nulls are shifted like values."""
    w = Window.partitionBy("recording_id").orderBy("idx")
    source = F.struct("value")
    moved = F.lag(source, n).over(w) if n >= 0 else F.lead(source, -n).over(w)
    return samples.withColumn("_moved", moved).where("_moved IS NOT NULL").withColumn("value", F.col("_moved.value")).drop("_moved")


def event_series(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``marker``: that of the last event (recording_id, t, marker) at or before each sample, else 0."""
    both = samples.select("recording_id", "t", "idx", F.lit(None).cast("int").alias("m")).unionByName(events.select("recording_id", "t", F.lit(None).cast("long").alias("idx"), F.col("marker").cast("int").alias("m")))
    w = Window.partitionBy("recording_id").orderBy("t", F.col("idx").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("marker", F.coalesce(F.last("m", ignorenulls=True).over(w), F.lit(0))).where("idx IS NOT NULL").select("recording_id", "idx", "t", "marker")
