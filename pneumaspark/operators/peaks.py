"""Crossings, strict extrema and valley-peak-valley breaths as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = "recording_id"


def _ordered() -> Window:
    return Window.partitionBy(BY).orderBy("idx")


def baseline_crossings(samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(recording_id, idx): places i where the sign of value - baseline differs between i and i + 1; zero is its own sign."""
    sign = F.signum(F.col("value") - F.col(baseline))
    return samples.withColumn("_s", sign).withColumn("_n", F.lead("_s").over(_ordered())).where("_n IS NOT NULL AND _n <> _s").select(BY, "idx")


def strict_extrema(samples: DataFrame) -> DataFrame:
    """Samples with ``is_peak`` and ``is_valley``: greater or smaller than both neighbours; ends are neither."""
    w, v = _ordered(), F.col("value")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    return samples.withColumn("is_peak", F.coalesce((v > before) & (v > after), F.lit(False))).withColumn("is_valley", F.coalesce((v < before) & (v < after), F.lit(False)))


def valley_peak_valley(extrema: DataFrame) -> DataFrame:
    """(recording_id, breath_no, start_idx, peak_idx, end_idx): neighbouring valleys with a peak strictly between, the first one.

    The next peak and valley come from a minimum that grows against the order of
    idx, so a recording is read once per direction.
    """
    later = Window.partitionBy(BY).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    next_peak = F.min(F.when(F.col("is_peak"), F.col("idx"))).over(later)
    next_valley = F.min(F.when(F.col("is_valley"), F.col("idx"))).over(later)
    found = extrema.where("is_peak OR is_valley").withColumn("peak_idx", next_peak).withColumn("end_idx", next_valley)
    breaths = found.where("is_valley AND peak_idx < end_idx").select(BY, F.col("idx").alias("start_idx"), "peak_idx", "end_idx")
    number = F.row_number().over(Window.partitionBy(BY).orderBy("start_idx")) - 1
    return breaths.select(BY, number.cast("long").alias("breath_no"), "start_idx", "peak_idx", "end_idx")


def onoff_from_crossings(crossings: DataFrame, peaks: DataFrame, samples: DataFrame) -> DataFrame:
    """(recording_id, peak_idx, start_idx, end_idx, start_valid, end_valid, valid): last crossing before a peak, else 0; the next one, else the last sample.

    The next one may be at the peak itself, unless no crossing lies before.  An end after the
    next peak isn't valid.  Where a start isn't after a valid end of the peak before, the one
    further from its own peak isn't valid; at equal distances that is the end.

    One union of peaks and crossings, two growing windows; no range join.
    """
    both = crossings.select(BY, "idx", F.lit(False).alias("is_peak")).unionByName(peaks.select(BY, "idx", F.lit(True).alias("is_peak")))
    crossing = F.when(~F.col("is_peak"), F.col("idx"))
    # ``rangeBetween(.., -1)`` is strict: a crossing at the peak itself counts as after it
    before = F.max(crossing).over(Window.partitionBy(BY).orderBy("idx").rangeBetween(Window.unboundedPreceding, -1))
    downwards = Window.partitionBy(BY).orderBy(F.desc("idx"))
    after = F.min(crossing).over(downwards.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    beyond = F.min(crossing).over(downwards.rangeBetween(Window.unboundedPreceding, -1))
    last = samples.groupBy(BY).agg(F.max("idx").alias("last_idx"))
    placed = (
        both.withColumns({"b": before, "a": after, "c": beyond})
        .where("is_peak")
        .join(last, BY)
        .select(
            BY,
            F.col("idx").alias("peak_idx"),
            F.coalesce("b", F.lit(0)).cast("long").alias("start_idx"),
            F.coalesce(F.when(F.col("b").isNull(), F.col("c")).otherwise(F.col("a")), "last_idx").alias("end_idx"),
        )
    )
    w = Window.partitionBy(BY).orderBy("peak_idx")
    p, start, end = F.col("peak_idx"), F.col("start_idx"), F.col("end_idx")
    placed = placed.withColumn("in_turn", F.coalesce(end <= F.lead(p).over(w), F.lit(True)))
    # positive where the start is further from its peak than the end before it from its own
    placed = placed.withColumn("excess", F.when((start <= F.lag(end).over(w)) & F.lag("in_turn").over(w), p - start - (F.lag(end).over(w) - F.lag(p).over(w))))
    start_valid, end_valid = F.coalesce(F.col("excess") <= 0, F.lit(True)), F.col("in_turn") & F.coalesce(F.lead("excess").over(w) > 0, F.lit(True))
    placed = placed.withColumns({"start_valid": start_valid, "end_valid": end_valid})
    return placed.select(BY, "peak_idx", "start_idx", "end_idx", "start_valid", "end_valid", (F.col("start_valid") & F.col("end_valid")).alias("valid"))


def closest_event(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(recording_id, t, nearest): the nearest candidate time of each reference, the earlier on a tie; reuse is allowed.

    Only the neighbours on both sides can be nearest: one union, two growing windows.
    """
    both = references.select(BY, "t", F.lit(True).alias("is_ref")).unionByName(candidates.select(BY, "t", F.lit(False).alias("is_ref")))
    c = F.when(~F.col("is_ref"), F.col("t"))
    before = F.max(c).over(Window.partitionBy(BY).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(c).over(Window.partitionBy(BY).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("b", before).withColumn("a", after).where("is_ref")
    nearest = F.when(F.col("a").isNull() | (F.col("t") - F.col("b") <= F.col("a") - F.col("t")), F.col("b")).otherwise(F.col("a"))
    return placed.select(BY, "t", nearest.alias("nearest"))


def reduce_runs(extrema: DataFrame) -> DataFrame:
    """Alternating extrema: of each run of valleys the lowest stays, of each run of peaks the highest; the earlier on ties."""
    w = _ordered()
    kind = F.when(F.col("is_peak"), 1).otherwise(-1)
    e = extrema.where("is_peak OR is_valley").withColumn("kind", kind)
    e = e.withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    best = Window.partitionBy(BY, "run").orderBy(F.desc(F.col("value") * F.col("kind")), "idx")
    return e.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "run", "new")


def normalize_breaths(peaks: DataFrame, samples: DataFrame, fs: float, width_seconds: float = 0.5) -> DataFrame:
    """Sample indices to breaths of a fixed width, inside the recording."""
    length = samples.groupBy(BY).agg((F.count(F.lit(1)) / F.lit(fs)).alias("duration"))
    t = F.col("idx") / F.lit(fs)
    return peaks.join(length, BY).select(
        BY,
        "idx",
        F.greatest(t - width_seconds / 2, F.lit(0.0)).alias("start_time"),
        t.alias("extremum_time"),
        F.least(t + width_seconds / 2, F.col("duration")).alias("end_time"),
    )
