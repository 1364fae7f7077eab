"""Slices, windows of a recording, interpolation and decimation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = "recording_id"


def slice_by_index(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Samples ``start <= idx < end``."""
    if end <= start:
        raise ValueError("the slice is empty")
    return samples.where((F.col("idx") >= start) & (F.col("idx") < end))


def slice_by_time(samples: DataFrame, start: float, end: float) -> DataFrame:
    """Samples ``start <= t < end``."""
    if end <= start:
        raise ValueError("the slice is empty")
    return samples.where((F.col("t") >= start) & (F.col("t") < end))


def slice_signal(samples: DataFrame, start: float, end: float, mode: str = "index") -> DataFrame:
    if mode not in ("index", "time"):
        raise ValueError(f"unknown slicing mode {mode!r}")
    return slice_by_index(samples, int(start), int(end)) if mode == "index" else slice_by_time(samples, start, end)


def keep_seconds(samples: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """A window in seconds from each recording's own first time; the kept samples are numbered anew.

    The recording's start on a shared clock moves by ``shift``, which is added as a column.
    """
    every = Window.partitionBy(BY)
    since = F.col("t") - F.min("t").over(every)
    kept = samples.withColumn("_since", since).where((F.col("_since") >= start) & (F.lit(True) if end is None else F.col("_since") < end))
    first = F.min("idx").over(every)
    return kept.withColumn("shift", F.min("_since").over(every)).withColumn("idx", F.col("idx") - first).drop("_since")


def cut_ends(samples: DataFrame, front: float, back: float) -> DataFrame:
    """Drop ``front`` seconds at the begin and ``back`` seconds at the end of every recording."""
    every = Window.partitionBy(BY)
    return (
        samples.withColumn("_a", F.min("t").over(every) + front)
        .withColumn("_b", F.max("t").over(every) - back)
        .where("t >= _a AND t <= _b")
        .drop("_a", "_b")
    )


def interpolate_to_time(samples: DataFrame, times: DataFrame) -> DataFrame:
    """(recording_id, t, value): linear interpolation onto ``times`` (recording_id, t); null outside.

    Both axes are united and each new time looks at the sample before and after
    it, so the plan is one sort of a recording and no range join.
    """
    known = samples.select(BY, "t", F.col("value").alias("v"), F.lit(False).alias("wanted"))
    both = known.unionByName(times.select(BY, "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("wanted")))
    point = F.when(~F.col("wanted"), F.struct("t", "v"))
    before = F.last(point, ignorenulls=True).over(Window.partitionBy(BY).orderBy("t", "wanted").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, ignorenulls=True).over(Window.partitionBy(BY).orderBy(F.desc("t"), "wanted").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.select(BY, "t", "wanted", before.alias("b"), after.alias("a")).where("wanted")
    span = F.col("a.t") - F.col("b.t")
    value = F.when(span == 0, F.col("b.v")).otherwise(F.col("b.v") + (F.col("a.v") - F.col("b.v")) * F.try_divide(F.col("t") - F.col("b.t"), span))
    return placed.select(BY, "t", value.alias("value"))


def reduce_points(samples: DataFrame, max_points: int) -> DataFrame:
    """Keep the least and the greatest sample of each of ``max_points // 2`` equal chunks of a recording."""
    every = Window.partitionBy(BY)
    chunks = max(1, max_points // 2)
    chunk = F.floor(F.col("idx") * chunks / F.count(F.lit(1)).over(every)).cast("long")
    placed = samples.withColumn("chunk", chunk)
    low = F.min(F.struct("value", "idx"))
    high = F.max(F.struct("value", (-F.col("idx")).alias("before")))
    ends = placed.groupBy(BY, "chunk").agg(low.alias("low"), high.alias("high"))
    return ends.select(BY, F.explode(F.array_distinct(F.array(F.struct(F.col("low.idx").alias("idx"), F.col("low.value").alias("value")), F.struct((-F.col("high.before")).alias("idx"), F.col("high.value").alias("value"))))).alias("p")).select(BY, "p.idx", "p.value")


def concat_recordings(parts: DataFrame) -> DataFrame:
    """Join parts (recording_id, part, t, value) end to end.

    Adds ``idx`` over the whole and, at each part's first sample, ``gap`` (seconds
    since the part before) and ``in_order`` (it starts after that part's end).
    """
    w = Window.partitionBy(BY).orderBy("part", "t")
    prev_t, prev_part = F.lag("t").over(w), F.lag("part").over(w)
    new_part = prev_part.isNotNull() & (prev_part != F.col("part"))
    return parts.select(
        BY,
        "part",
        "t",
        "value",
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.when(new_part, F.col("t") - prev_t).alias("gap"),
        F.when(new_part, F.col("t") > prev_t).alias("in_order"),
    )
