"""Per-breath and per-recording features.

Breaths are (recording_id, breath_no, start_idx, peak_idx, end_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.operators.rangejoin import in_intervals

BY = "recording_id"
BREATH = [BY, "breath_no"]


def _at(breaths: DataFrame, samples: DataFrame, column: str, name: str, value: str = "value") -> DataFrame:
    """Adds the sample value at an index column of the breaths; null where there is no such sample."""
    return breaths.join(samples.select(BY, F.col("idx").alias(column), F.col(value).alias(name)), [BY, column], "left")


def time_to_peak(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    """Samples from a breath's start to its greatest value over [start, end), and as a share of its length; the first on ties."""
    inside = in_intervals(samples.select(BY, "idx", "value"), breaths, closed=False)
    top = inside.groupBy(*BREATH).agg(F.max_by("idx", F.struct("value", -F.col("idx"))).alias("top"), F.first("start_idx").alias("s"), F.first("end_idx").alias("e"))
    n = F.col("top") - F.col("s")
    return top.select(*BREATH, n.alias("samples"), (n / (F.col("e") - F.col("s"))).alias("fraction"))


def pseudo_slope(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    """Greatest absolute value over [start, end), by its position in the breath; null at position 0."""
    inside = in_intervals(samples.select(BY, "idx", F.abs("value").alias("value")), breaths, closed=False)
    top = inside.groupBy(*BREATH).agg(F.max(F.struct("value", -F.col("idx"))).alias("top"), F.first("start_idx").alias("s"))
    position = -F.col("top.col2") - F.col("s")
    return top.select(*BREATH, F.try_divide(F.col("top.value"), position).alias("slope"))


def amplitude_at_peaks(samples: DataFrame, breaths: DataFrame, baseline: str | None = None) -> DataFrame:
    """Value at the peak over the baseline, which is 0 unless a column of the samples is named."""
    over = F.col("value") - (F.col(baseline) if baseline else F.lit(0.0))
    return _at(breaths, samples.withColumn("_over", over), "peak_idx", "amplitude", "_over").select(*BREATH, "amplitude")


def time_product(samples: DataFrame, breaths: DataFrame, fs: float, baseline: str | None = None) -> DataFrame:
    """Absolute trapezoid integral of value - baseline over [start, end], ends included."""
    d = F.col("value") - (F.col(baseline) if baseline else F.lit(0.0))
    step = samples.select(BY, "idx", d.alias("d")).withColumn("area", (F.col("d") + F.lag("d").over(Window.partitionBy(BY).orderBy("idx"))) / 2 / F.lit(fs))
    inside = in_intervals(step, breaths)
    # the first sample of a breath closes no trapezoid of it
    area = F.sum(F.when(F.col("idx") > F.col("start_idx"), F.col("area")).otherwise(0.0))
    return inside.groupBy(*BREATH).agg(F.abs(area).alias("time_product"))


def area_under_baseline(samples: DataFrame, breaths: DataFrame, fs: float, window: int, baseline: str = "baseline") -> DataFrame:
    """Area between the baseline and a reference level, and that level.

    If at least half of the value - baseline signs after a breath's first sample aren't negative, the level is
    the least value in [peak - window, min(n - 1, peak + window)); else the greatest, and the area is flipped.
    """
    s = samples.select(BY, "idx", "value", F.col(baseline).alias("base"))
    inside = in_intervals(s, breaths)
    share = F.avg(F.when(F.col("idx") > F.col("start_idx"), (F.col("value") >= F.col("base")).cast("double")))
    up = inside.groupBy(*BREATH).agg((share >= 0.5).alias("up"), F.sort_array(F.collect_list(F.struct("idx", "base"))).alias("rows"))
    last = samples.groupBy(BY).agg(F.max("idx").alias("last_idx"))
    around = breaths.join(last, BY).select(*BREATH, F.greatest(F.col("peak_idx") - window, F.lit(0)).alias("lo"), (F.least(F.col("last_idx"), F.col("peak_idx") + window) - 1).alias("hi"))
    level = in_intervals(s, around, "lo", "hi").groupBy(*BREATH).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    y = F.when(F.col("up"), F.col("low")).otherwise(F.col("high"))
    flip = F.when(F.col("up"), 1.0).otherwise(-1.0)
    base = F.col("rows.base")
    area = F.aggregate(
        F.sequence(F.lit(1), F.size(base) - 1), F.lit(0.0), lambda a, i: a + (F.get(base, i - 1) + F.get(base, i)) / 2 - F.col("y")
    ) / F.lit(fs)
    return up.join(level, BREATH).withColumn("y", y).where(F.size("rows") > 1).select(*BREATH, (area * flip).alias("area"), F.col("y").alias("y_ref"))


def respiratory_rate(peaks: DataFrame, fs: float, percentile: float = 33, factor: float = 3) -> DataFrame:
    """Per recording the median of 60 fs / distance, without rates over ``factor`` times their percentile; null below two peaks."""
    rate = 60 * fs / (F.col("idx") - F.lag("idx").over(Window.partitionBy(BY).orderBy("idx")))
    rates = peaks.select(BY, rate.alias("rate"))
    limit = F.percentile("rate", F.lit(percentile / 100)).over(Window.partitionBy(BY)) * factor
    kept = rates.withColumn("limit", limit)
    return kept.groupBy(BY).agg(F.median(F.when(F.col("rate") <= F.col("limit"), F.col("rate"))).alias("rate"), F.count("rate").alias("n_rates"))


def tidal_variation(samples: DataFrame, breaths: DataFrame, method: str = "inspiratory") -> DataFrame:
    """Value at the peak over that at the start, at the end, or over their mean."""
    b = breaths
    for column, name in (("start_idx", "vs"), ("peak_idx", "vm"), ("end_idx", "ve")):
        b = _at(b, samples, column, name)
    low: dict[str, Column] = {"inspiratory": F.col("vs"), "expiratory": F.col("ve"), "mean": (F.col("vs") + F.col("ve")) / 2}
    return b.select(*BREATH, (F.col("vm") - low[method]).alias("tidal_variation"))


def end_expiratory_level(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    """Value at each breath's end."""
    return _at(breaths, samples, "end_idx", "eeli").select(*BREATH, "eeli")


def estimate_peep(samples: DataFrame, volume: str = "volume", digits: int | None = 0) -> DataFrame:
    """Per recording the median pressure (value) at strict minima of the volume, rounded to an integer unless digits is None."""
    w, v = Window.partitionBy(BY).orderBy("idx"), F.col(volume)
    low = samples.withColumn("_low", (v < F.lag(volume).over(w)) & (v < F.lead(volume).over(w))).where("_low")
    peep = F.median("value")
    return low.groupBy(BY).agg((peep if digits is None else F.round(peep, digits)).alias("peep"), F.count(F.lit(1)).alias("n_minima"))


def interval_cv(intervals: DataFrame) -> DataFrame:
    """Per recording: mean, population deviation, their ratio and the number of durations (end_idx - start_idx)."""
    d = (F.col("end_idx") - F.col("start_idx")).cast("double")
    out = intervals.groupBy(BY).agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


def snr_pseudo(samples: DataFrame, breaths: DataFrame, fs: float, envelope: str = "value", baseline: str = "baseline") -> DataFrame:
    """Envelope at the peak by the median baseline within half a second around it (our definition)."""
    half = int(fs / 2)
    near = breaths.select(*BREATH, "peak_idx", F.greatest(F.col("peak_idx") - half, F.lit(0)).alias("lo"), (F.col("peak_idx") + half).alias("hi"))
    noise = in_intervals(samples.select(BY, "idx", F.col(baseline).alias("base")), near, "lo", "hi").groupBy(*BREATH).agg(F.median("base").alias("noise"))
    return _at(breaths, samples, "peak_idx", "top", envelope).join(noise, BREATH).select(*BREATH, F.try_divide(F.col("top"), F.col("noise")).alias("snr"))
