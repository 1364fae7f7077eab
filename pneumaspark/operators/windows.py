"""Rolling envelopes, moving averages and baselines as window expressions.

Every operator takes ``samples`` (recording_id, idx, value, ...) and adds a
column.  Nulls are skipped, as NaN is.  A window of one recording is one sorted
partition; ``chunks.in_chunks`` runs those with a bounded frame on parts of a long
recording, and baselines always go by chunk.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from pneumaspark.operators import chunks
from pneumaspark.operators.kernels import rolling

BY = "recording_id"


def ordered() -> Window:
    return Window.partitionBy(BY).orderBy("idx")


def frame(length: int, center: bool = True) -> Window:
    """The rolling frame: ``[i - w // 2, i + (w - 1) // 2]`` if centred, else the last ``w`` samples."""
    return ordered().rowsBetween(-(length // 2), (length - 1) // 2) if center else ordered().rowsBetween(1 - length, 0)


#: Windows of more samples go by chunk and kernel: an expression would visit a window's samples one by one for every row.
WIDE = 64


def rolling_envelope(samples: DataFrame, length: int, method: str = "rms", center: bool = True, min_periods: int = 1, column: str = "envelope") -> DataFrame:
    """Rolling root mean square, mean absolute value or median absolute value."""
    w, v = frame(length, center), F.col("value")
    made: dict[str, Column] = {
        "rms": F.sqrt(F.avg(v * v).over(w)),
        "arv": F.avg(F.abs(v)).over(w),
        "median": F.percentile(F.abs(v), F.lit(0.5)).over(w),
    }
    if method not in made:
        raise ValueError(f"unknown envelope method {method!r}; choose from {sorted(made)}")
    if length <= WIDE or not isinstance(samples.schema[BY].dataType, AtomicType):
        return samples.withColumn(column, F.when(F.count(v).over(w) >= min_periods, made[method]))
    before, after = (length // 2, (length - 1) // 2) if center else (length - 1, 0)
    kernels = {"rms": rolling.rms, "arv": rolling.arv, "median": lambda x, a, b: rolling.running_percentile(np.abs(x), a, b, 50)}

    def kernel(idx: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        y = kernels[method](x, before, after)
        there = rolling.sums(~np.isnan(x), before, after) if min_periods > 1 else None
        return {column: y if there is None else np.where(there >= min_periods, y, np.nan)}

    return chunks.map_chunks(samples, kernel, (column,), halo=length)


def student_t(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection of its distribution function (numerical integration)."""

    def cdf(x: float) -> float:
        # integrate cos(u)^(df-1) with t = sqrt(df) tan(u), by Simpson's rule
        top, n = math.atan(x / math.sqrt(df)), 2000
        h = top / n
        s = sum((4 if k % 2 else 2) * math.cos(k * h) ** (df - 1) for k in range(1, n)) + 1 + math.cos(top) ** (df - 1)
        norm = math.gamma((df + 1) / 2) / (math.sqrt(math.pi) * math.gamma(df / 2))
        return 0.5 + norm * s * h / 3

    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def rolling_ci(samples: DataFrame, length: int, method: str = "rms", alpha: float = 0.05) -> DataFrame:
    """Confidence bounds ``low`` and ``high`` of the rolling envelope.

    The standard error is the sample deviation over the root of count - 1.  For
    ``rms`` it is that of the squares, and the bounds are roots; for ``arv`` it is
    that of the signed values.
    """
    w, v = frame(length), F.col("value")
    t = F.lit(student_t(1 - alpha / 2, length - 1))
    spread = v * v if method == "rms" else v
    sem = F.stddev_samp(spread).over(w) / F.sqrt(F.nullif(F.count(v).over(w) - 1, F.lit(0)))
    mid = F.avg(v * v).over(w) if method == "rms" else F.avg(F.abs(v)).over(w)
    low, high = mid - t * sem, mid + t * sem
    if method == "rms":
        low, high = F.when(low >= 0, F.sqrt(low)), F.sqrt(high)
    return samples.withColumn("low", low).withColumn("high", high)


def blackman(length: int) -> list[float]:
    """Blackman weights that sum to one."""
    raw = [0.42 - 0.5 * math.cos(2 * math.pi * k / (length - 1)) + 0.08 * math.cos(4 * math.pi * k / (length - 1)) for k in range(length)]
    return [r / sum(raw) for r in raw]


def moving_average(samples: DataFrame, length: int, weights: list[float] | None = None, padding: str = "edge", column: str = "average") -> DataFrame:
    """Centred moving average; an even window grows by one.

    ``padding``: ``edge`` repeats the first and last sample, ``constant`` pads with
    zeros, ``none`` averages the samples there are.  Weights are convolved, so an
    asymmetric set is applied in reverse.
    """
    length += 1 - length % 2
    half, w = length // 2, ordered()
    every = Window.partitionBy(BY)
    if padding == "none":
        return samples.withColumn(column, F.avg("value").over(w.rowsBetween(-half, half)))
    if weights is None and padding == "edge":
        n = F.count(F.lit(1)).over(every)
        first, last = F.min_by("value", "idx").over(every), F.max_by("value", "idx").over(every)
        position = F.row_number().over(w) - 1
        left, right = F.greatest(F.lit(half) - position, F.lit(0)), F.greatest(position + half - (n - 1), F.lit(0))
        return samples.withColumn(column, (F.sum("value").over(w.rowsBetween(-half, half)) + left * first + right * last) / F.lit(length))
    weights = list(reversed(weights or [1 / length] * length))
    before = F.lit(0.0) if padding == "constant" else F.min_by("value", "idx").over(every)
    after = F.lit(0.0) if padding == "constant" else F.max_by("value", "idx").over(every)
    terms = []
    for k in range(-half, half + 1):
        v = F.col("value") if k == 0 else F.coalesce(F.lag("value", -k).over(w), before) if k < 0 else F.coalesce(F.lead("value", k).over(w), after)
        terms.append(F.lit(weights[k + half]) * v)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return samples.withColumn(column, total)


def running_smoother(packed: DataFrame) -> DataFrame:
    """(recording_id, smoothed): mean of the absolute values of the next tenth of the recording; zeros at the end."""
    n = F.expr("size(values) div 10")
    smoothed = F.expr(
        "transform(sequence(0, size(values) - 1), i -> CASE WHEN i > size(values) - n THEN 0D ELSE "
        "aggregate(slice(values, i + 1, n), 0D, (a, v) -> a + abs(v)) / n END)"
    )
    return packed.withColumn("n", n).where("n > 0").select(BY, smoothed.alias("smoothed"))


def naive_rolling_rms(samples: DataFrame, length: int) -> DataFrame:
    """(recording_id, idx, rms): the root mean square of samples idx+1 to idx+length, where all are there."""
    w = ordered().rowsBetween(1, length)
    out = samples.select(BY, "idx", F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)).alias("rms"), F.count("value").over(w).alias("n"))
    return out.where(F.col("n") == length).drop("n")


def _steps(length: int, step: int) -> int:
    """A chunk's length in whole steps, so that no step is in two chunks."""
    return max(1, -(-length // step)) * step


def moving_baseline(samples: DataFrame, window: int, step: int, percentile: float = 33.0, column: str = "baseline", length: int = chunks.LENGTH) -> DataFrame:
    """A percentile around each step's first sample, held over the step; cut short at the ends.

    Only the anchors' windows are ranked, chunk by chunk; rows of a step whose first sample isn't there have none and go.
    """
    halo = window // 2
    based = chunks.map_chunks(samples, lambda idx, x: {column: rolling.moving_baseline(idx, x, window, step, percentile)}, (column,), _steps(length, step), halo)
    return based.where(F.col(column).isNotNull())


def slopesum_baseline(samples: DataFrame, window: int, step: int, average: int, near: int, percentile: float = 33.0, augmented: float = 25.0, length: int = chunks.LENGTH) -> DataFrame:
    """Baseline over quiet samples, with running mean and deviation (our definition).

    The slope sum of a sample is the sum of absolute differences over ``average``
    samples.  A sample is quiet where its slope sum doesn't exceed the ``augmented``
    percentile of the ``near`` samples around.  The baseline is the percentile of
    the quiet samples in the window, or of all where none is quiet.
    """
    names = ("slope_sum", "baseline", "running_mean", "running_std")
    halo = window // 2 + near + average + 1
    return chunks.map_chunks(samples, lambda idx, x: rolling.slopesum_baseline(idx, x, window, step, average, near, percentile, augmented), names, _steps(length, step), halo)


def local_extrema_flags(samples: DataFrame) -> DataFrame:
    """``flag``: 1 where the slope turns from up to not up, -1 where from down to not down, else 0; 0 at the ends."""
    w, v = ordered(), F.col("value")
    before, after = v - F.lag("value").over(w), F.lead("value").over(w) - v
    flag = F.when((before > 0) & (after <= 0), 1).when((before < 0) & (after >= 0), -1).otherwise(0)
    return samples.withColumn("flag", flag.cast("int"))
