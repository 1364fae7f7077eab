"""Quality flags: a value, a threshold and a verdict for each breath or recording."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.operators.kernels import bell
from pneumaspark.operators.rangejoin import in_intervals

BY = "recording_id"
BREATH = [BY, "breath_no"]
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}


def threshold_flag(df: DataFrame, name: str, value: str, threshold: float, comparison: str | Callable[[Column, Column], Column], severity: str = "info") -> DataFrame:
    """Adds ``flag``, ``passed``, ``threshold`` and ``severity``; a null value doesn't pass."""
    compare = COMPARISONS[comparison] if isinstance(comparison, str) else comparison
    passed = F.coalesce(compare(F.col(value), F.lit(threshold)), F.lit(False))
    return df.withColumns({"flag": F.lit(name), "passed": passed, "threshold": F.lit(float(threshold)), "severity": F.lit(severity)})


def fraction_flag(df: DataFrame, name: str, passed: str, minimum: float, by: str = BY) -> DataFrame:
    """Per group the share of true rows, and whether it reaches the minimum."""
    share = F.avg(F.coalesce(F.col(passed), F.lit(False)).cast("double"))
    return df.groupBy(by).agg(share.alias("fraction")).withColumns({"flag": F.lit(name), "passed": F.col("fraction") >= minimum})


def timing_window_flag(df: DataFrame, name: str, delta: str, low: float | None, high: float | None, by: str = BY) -> DataFrame:
    """Per group whether all deltas are there and within [low, high]; a bound of None is open."""
    ok = F.col(delta).isNotNull() & ~F.isnan(delta)
    ok = ok & (F.col(delta) >= low) if low is not None else ok
    ok = ok & (F.col(delta) <= high) if high is not None else ok
    return df.groupBy(by).agg(F.bool_and(ok).alias("passed"), F.count(F.lit(1)).alias("n")).withColumn("flag", F.lit(name))


def result_flag(df: DataFrame, name: str, verdict: str) -> DataFrame:
    """A boolean column is the verdict; any other is a measurement, which doesn't pass."""
    boolean = dict(df.dtypes)[verdict] == "boolean"
    return df.withColumns({"flag": F.lit(name), "passed": F.col(verdict) if boolean else F.lit(False), "measurement_only": F.lit(not boolean)})


def skipped_flag(df: DataFrame, name: str, reason: str) -> DataFrame:
    return df.withColumns({"flag": F.lit(name), "passed": F.lit(False), "severity": F.lit("warning"), "skipped": F.lit(reason)})


def local_high_aub(areas: DataFrame, value: str = "area", percentile: float = 75.0, factor: float = 4.0) -> DataFrame:
    """Passes where the area is at most ``factor`` times the recording's percentile."""
    limit = factor * F.percentile(value, F.lit(percentile / 100)).over(Window.partitionBy(BY))
    return areas.withColumn("threshold", limit).withColumn("passed", F.col(value) <= F.col("threshold"))


def extreme_time_products(products: DataFrame, value: str = "time_product", upper: float = 95.0, upper_factor: float = 10.0, lower: float = 5.0, lower_factor: float = 0.1) -> DataFrame:
    """Passes within [lower_factor P_lower, upper_factor P_upper] of the recording."""
    w = Window.partitionBy(BY)
    out = products.withColumn("low", lower_factor * F.percentile(value, F.lit(lower / 100)).over(w))
    out = out.withColumn("high", upper_factor * F.percentile(value, F.lit(upper / 100)).over(w))
    return out.withColumn("passed", (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def interpeak_distance(first: DataFrame, second: DataFrame, threshold: float = 1.1) -> DataFrame:
    """Per recording: median distance of ``second`` peaks by that of ``first``; passes above the threshold."""

    def gaps(peaks: DataFrame, name: str) -> DataFrame:
        d = F.col("idx") - F.lag("idx").over(Window.partitionBy(BY).orderBy("idx"))
        return peaks.select(BY, d.cast("double").alias("d")).groupBy(BY).agg(F.median("d").alias(name))

    both = gaps(first, "d1").join(gaps(second, "d2"), BY).withColumn("ratio", F.try_divide(F.col("d2"), F.col("d1")))
    return both.withColumn("passed", F.coalesce(F.col("ratio") > threshold, F.lit(False)))


def percentage_under_baseline(areas: DataFrame, products: DataFrame, limit: float = 40.0) -> DataFrame:
    """100 area / (area + time product) per breath; passes up to the limit, to nine decimals, so the order of a sum decides nothing (our definition)."""
    share = F.try_divide(100 * F.col("area"), F.col("area") + F.col("time_product"))
    return areas.join(products, BREATH).select(*BREATH, share.alias("percentage")).withColumn("passed", F.coalesce(F.round("percentage", 9) <= limit, F.lit(False)))


def non_consecutive(breaths: DataFrame, manoeuvres: DataFrame) -> DataFrame:
    """(recording_id, idx, n_between, valid): breaths strictly between a manoeuvre and the next; valid where there are none.

    A running count of breaths replaces the range join; the last one is valid.
    """
    both = breaths.select(BY, "idx", F.lit(False).alias("m")).unionByName(manoeuvres.select(BY, "idx", F.lit(True).alias("m")))
    w = Window.partitionBy(BY).orderBy("idx")
    is_breath = (~F.col("m")).cast("long")
    upto = F.sum(is_breath).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.coalesce(F.sum(is_breath).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = both.withColumn("upto", upto).withColumn("below", below).where("m")
    n = F.lead("below").over(w) - F.col("upto")
    return m.withColumn("n_between", n).select(BY, "idx", F.col("n_between"), F.coalesce(F.col("n_between") <= 0, F.lit(True)).alias("valid"))


def rate_agreement(counts: DataFrame, minimum: float = 0.1) -> DataFrame:
    """From (recording_id, n_breaths, duration, rate): detected rate by the ventilator's; passes above the minimum."""
    fraction = F.try_divide(F.try_divide(F.col("n_breaths"), F.col("duration") / 60), F.col("rate"))
    return counts.withColumn("fraction", fraction).withColumn("passed", F.coalesce(F.col("fraction") > minimum, F.lit(False)))


def event_timing(first: DataFrame, second: DataFrame, low: float = -0.5, high: float = 2.0) -> DataFrame:
    """Pairs by position: (recording_id, position, paired, delta, passed); events beyond the shorter list aren't paired, have no delta and don't pass."""

    def placed(e: DataFrame, name: str) -> DataFrame:
        return e.select(BY, F.col("t").alias(name), (F.row_number().over(Window.partitionBy(BY).orderBy("t")) - 1).cast("long").alias("position"))

    both = placed(first, "t1").join(placed(second, "t2"), [BY, "position"], "full_outer").withColumn("delta", F.col("t2") - F.col("t1"))
    return both.select(BY, "position", F.col("delta").isNotNull().alias("paired"), "delta", F.coalesce(F.col("delta").between(low, high), F.lit(False)).alias("passed"))


def unpaired_events(timing: DataFrame) -> DataFrame:
    """Per recording with unpaired events in ``event_timing``: their number, as a flag that failed with a warning."""
    return timing.where("NOT paired").groupBy(BY).agg(F.count(F.lit(1)).alias("n_unpaired")).withColumns({"flag": F.lit("event_timing_unpaired"), "passed": F.lit(False), "severity": F.lit("warning")})


def pocc_quality(samples: DataFrame, manoeuvres: DataFrame, limits: Sequence[float] = (0.0, 2.0, 0.8)) -> DataFrame:
    """Upslope criteria on differences between a manoeuvre's peak and end (recording_id, breath_no, peak_idx, end_idx, time_product).

    P10 of the differences at least the first limit, P90 at most the second, and P90
    over the root of the time product at most the third (our normaliser).
    """
    dp = samples.select(BY, "idx", (F.col("value") - F.lag("value").over(Window.partitionBy(BY).orderBy("idx"))).alias("dp"))
    m = manoeuvres.withColumn("first_idx", F.col("peak_idx") + 1)
    inside = in_intervals(dp, m, "first_idx", "end_idx")
    out = inside.groupBy(*BREATH).agg(F.percentile("dp", F.lit(0.1)).alias("p10"), F.percentile("dp", F.lit(0.9)).alias("p90"), F.first("time_product").alias("tp"))
    out = out.withColumn("p90_norm", F.try_divide(F.col("p90"), F.sqrt("tp")))
    ok = (F.col("p10") >= limits[0]) & (F.col("p90") <= limits[1]) & (F.col("p90_norm") <= limits[2])
    return out.select(*BREATH, "p10", "p90", "p90_norm", F.coalesce(ok, F.lit(False)).alias("passed"))


def remove_invalid_breaths(breaths: DataFrame, flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Breaths none of whose latest flags (recording_id, breath_no, name, seq, passed) of the given names failed."""
    latest = flags.where(F.col("name").isin(*names)).groupBy(*BREATH, "name").agg(F.max_by("passed", "seq").alias("passed"))
    return breaths.join(latest.where(~F.col("passed")).select(*BREATH).distinct(), BREATH, "left_anti")


#: Samples whose breaths are fitted at once.
FITTED_AT_ONCE = 1 << 17


def bell_curve_error(samples: DataFrame, breaths: DataFrame, fs: float, limit: float = 40.0) -> DataFrame:
    """Area between a breath's samples and a fitted Gaussian, in percent of its time product; passes up to the limit (our definition).

    A task streams its breaths' samples, sorted, and fits many breaths at once.
    """
    inside = in_intervals(samples.select(BY, "idx", "value"), breaths.select(*BREATH, "start_idx", "peak_idx", "end_idx"), bucket=32)
    rows = inside.select(F.col(BY).cast("long").alias(BY), F.col("breath_no").cast("long").alias("breath_no"), F.col("peak_idx").cast("long").alias("peak_idx"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fitted(held: list[tuple[np.ndarray, ...]], last: bool) -> tuple[pa.RecordBatch | None, list[tuple[np.ndarray, ...]]]:
            """What the whole breaths among the rows give, and the rows of the one that may go on."""
            r, b, peak, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (b[1:] != b[:-1]))))
            end = len(r) if last else int(starts[-1])
            starts = starts if last else starts[:-1]
            if not len(starts):
                return None, [(r, b, peak, x, y)]
            found = bell.errors(x[:end].astype(float), y[:end], starts, peak[starts], fs)
            made = [pa.array(r[starts]), pa.array(b[starts]), pa.array(found, from_pandas=True), pa.array(found <= limit)]
            return pa.RecordBatch.from_arrays(made, [BY, "breath_no", "error", "passed"]), [(r[end:], b[end:], peak[end:], x[end:], y[end:])]

        held: list[tuple[np.ndarray, ...]] = []
        n, enough = 0, FITTED_AT_ONCE
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= enough:
                out, held = fitted(held, False)
                # a breath longer than that is waited for twice as long each time
                n = len(held[0][0])
                enough = max(FITTED_AT_ONCE, 2 * n)
                if out is not None:
                    yield out
        if n:
            out, _ = fitted(held, True)
            if out is not None:
                yield out

    placed = rows.repartition(*BREATH).sortWithinPartitions(*BREATH, "idx", "value")
    return placed.mapInArrow(error, f"{BY} long, breath_no long, error double, passed boolean")
