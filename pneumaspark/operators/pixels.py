"""Operators on frames (recording_id, frame_idx, pixels): sums, masks, lung space and pixel breaths.

Pixels are a row-major array; a null pixel is missing and takes no part in sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.operators import chunks
from pneumaspark.operators.kernels import gaps, iir

BY = "recording_id"


def global_impedance(frames: DataFrame) -> DataFrame:
    """(recording_id, idx, value): the sum of all pixels of a frame."""
    return frames.select(BY, F.col("frame_idx").alias("idx"), F.aggregate("pixels", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("value"))


def regional_impedance(frames: DataFrame, mask: list[float | None]) -> DataFrame:
    """(recording_id, idx, value): the sum of pixels times their weight in the mask; a null weight leaves a pixel out."""
    weights = F.array(*[F.lit(0.0 if m is None else float(m)) for m in mask])
    weighted = F.zip_with("pixels", weights, lambda x, m: F.coalesce(x, F.lit(0.0)) * m)
    return frames.select(BY, F.col("frame_idx").alias("idx"), F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x).alias("value"))


def masked_impedance(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Sum of the pixels within each recording's own mask (recording_id, pixel, weight)."""
    per_mask = masks.where("weight IS NOT NULL").groupBy(BY).agg(F.map_from_entries(F.collect_list(F.struct("pixel", "weight"))).alias("m"))
    inside = F.aggregate(F.transform("pixels", lambda x, i: F.coalesce(x * F.try_element_at(F.col("m"), i), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return frames.join(per_mask, BY).select(BY, F.col("frame_idx").alias("idx"), inside.alias("value"))


def pixel_samples(frames: DataFrame) -> DataFrame:
    """(recording_id, idx, pixel, z): frames in long form."""
    return frames.select(BY, F.col("frame_idx").alias("idx"), F.posexplode("pixels").alias("pixel", "z"))


def pixel_tiv(frames: DataFrame, breaths: DataFrame) -> DataFrame:
    """(recording_id, breath_no, pixel, tiv): value at the breath's peak over that at its start, for each pixel.

    Only the two frames of a breath are joined; pixels are exploded afterwards.
    """
    at = frames.select(BY, F.col("frame_idx"), "pixels")
    s = at.select(BY, F.col("frame_idx").alias("start_idx"), F.col("pixels").alias("ps"))
    m = at.select(BY, F.col("frame_idx").alias("peak_idx"), F.col("pixels").alias("pm"))
    both = breaths.join(s, [BY, "start_idx"]).join(m, [BY, "peak_idx"])
    return both.select(BY, "breath_no", F.posexplode(F.zip_with("pm", "ps", lambda a, b: a - b)).alias("pixel", "tiv"))


def lungspace(values: DataFrame, value: str, threshold: float = 0.15) -> DataFrame:
    """(recording_id, pixel, mean, included): pixels whose mean is at least a share of the greatest mean."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    mean = values.groupBy(BY, "pixel").agg(F.avg(value).alias("mean"))
    top = F.max("mean").over(Window.partitionBy(BY))
    return mean.withColumn("included", F.col("mean") >= threshold * top)


def pixel_amplitude(frames: DataFrame, breaths: DataFrame) -> DataFrame:
    """(recording_id, breath_no, pixel, amplitude): greatest less least value within the breath."""
    from pneumaspark.operators.rangejoin import in_intervals

    z = in_intervals(pixel_samples(frames), breaths.select(BY, "breath_no", "start_idx", "end_idx"))
    return z.groupBy(BY, "breath_no", "pixel").agg((F.max("z") - F.min("z")).alias("amplitude"))


_SUMS = ("n", "a", "aa", "b", "bb", "ab")


def pixel_lags(frames: DataFrame, most: int, length: int = 4096) -> DataFrame:
    """(recording_id, pixel, lag, correlation): by how many frames each pixel comes after the sum of all, ``most`` either way.

    The lag at which the pixel is most alike, over all frames that have both; of equal ones the
    least, the earlier first.  Sums of products are taken chunk by chunk and added, so a recording is never in one place.
    A pixel that never changes has no lag.
    """
    lags = np.arange(-most, most + 1)

    def kernel(idx: np.ndarray, grid: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
        total, at = np.nansum(grid, axis=1), np.flatnonzero(own)
        out = {name: [] for name in _SUMS}
        for lag in lags:
            there = at[(at + lag >= 0) & (at + lag < len(grid))]
            z = grid[there + lag]
            known = np.isfinite(z)
            z, g = np.where(known, z, 0.0), np.where(known, total[there][:, None], 0.0)
            for name, v in zip(_SUMS, (known, g, g * g, z, z * z, g * z), strict=True):
                out[name].append(v.sum(axis=0, dtype=float))
        made = {name: np.concatenate(v) for name, v in out.items()}
        return made | {"pixel": np.tile(np.arange(grid.shape[1], dtype=np.int32), len(lags)), "lag": np.repeat(lags.astype(np.int32), grid.shape[1])}

    parts = chunks.reduce_frames(frames, kernel, "pixel int, lag int, " + ", ".join(f"{name} double" for name in _SUMS), length, most)
    s = parts.groupBy(BY, "pixel", "lag").agg(*[F.sum(name).alias(name) for name in _SUMS])
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb)
    good = s.where("n > 1").withColumns({"va": va, "vb": vb, "r": r}).where("va > 1e-12 * aa AND vb > 1e-12 * bb")
    best = good.groupBy(BY, "pixel").agg(F.max(F.struct("r", (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("early"))).alias("m"))
    return best.select(BY, "pixel", (-F.col("m.early")).cast("int").alias("lag"), F.col("m.r").alias("correlation"))


PHASES = ("negative amplitude", "phase shift", "none")


def pixel_breaths(frames: DataFrame, breaths: DataFrame, phase: str | None = "negative amplitude", lags: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(recording_id, breath_no, pixel, start_idx, middle_idx, end_idx) within each global breath (our definition).

    The middle is the greatest value; start and end are the least before and after.  ``phase`` says what becomes of pixels out
    of step with the whole: ``negative amplitude`` takes the extremes of the other kind where a pixel falls while the whole rises;
    ``phase shift`` looks in the breath moved by the pixel's lag (``pixel_lags``, ``most`` frames either way, unless given); ``none`` does nothing.
    """
    from pneumaspark.operators.rangejoin import in_intervals

    phase = phase or "none"
    if phase not in PHASES:
        raise ValueError(f"unknown phase correction {phase!r}; choose from {PHASES}")
    samples = pixel_samples(frames)
    if phase == "phase shift":
        found = (pixel_lags(frames, most) if lags is None else lags).select(BY, "pixel", "lag")
        samples = samples.join(found, [BY, "pixel"], "left").withColumn("lag", F.coalesce("lag", F.lit(0))).withColumn("idx", F.col("idx") - F.col("lag"))
    else:
        samples = samples.withColumn("lag", F.lit(0))
    z = in_intervals(samples, breaths)
    w = Window.partitionBy(BY, "breath_no", "pixel")
    u = F.col("z")
    if phase == "negative amplitude":
        sign = F.signum(F.max(F.when(F.col("idx") == F.col("peak_idx"), F.col("z"))).over(w) - F.max(F.when(F.col("idx") == F.col("start_idx"), F.col("z"))).over(w))
        u = F.col("z") * F.when(sign < 0, -1.0).otherwise(1.0)
    z = z.withColumn("u", u)
    z = z.withColumn("mid", F.max(F.struct("u", (-F.col("idx")).alias("i"))).over(w)).withColumn("middle_idx", -F.col("mid.i"))
    before = F.min(F.when(F.col("idx") <= F.col("middle_idx"), F.struct("u", "idx")))
    after = F.min(F.when(F.col("idx") >= F.col("middle_idx"), F.struct("u", "idx")))
    out = z.groupBy(BY, "breath_no", "pixel").agg(before.alias("b"), F.first("middle_idx").alias("middle_idx"), after.alias("a"), F.first("lag").alias("lag"))
    lag = F.col("lag")
    return out.select(BY, "breath_no", "pixel", (F.col("b.idx") + lag).alias("start_idx"), (F.col("middle_idx") + lag).alias("middle_idx"), (F.col("a.idx") + lag).alias("end_idx"))


def label_regions(mask: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Connected components of a boolean grid, numbered from 1; connectivity 1 joins four neighbours, 2 eight."""
    labels, number = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 2 or not (a and b))]
    for at in zip(*np.nonzero(mask), strict=True):
        if labels[at]:
            continue
        number += 1
        labels[at], todo = number, [at]
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                near = (r + a, c + b)
                if 0 <= near[0] < mask.shape[0] and 0 <= near[1] < mask.shape[1] and mask[near] and not labels[near]:
                    labels[near] = number
                    todo.append(near)
    return labels


def filter_regions(masks: DataFrame, min_size: int = 10, connectivity: int = 1, n_cols: int = 8) -> DataFrame:
    """(recording_id, pixel, included): masks without their components of fewer than ``min_size`` pixels."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["pixel"].max()) + 1
        grid = np.zeros(-(-n // n_cols) * n_cols, bool)
        grid[pdf["pixel"]] = pdf["included"].fillna(False).astype(bool)
        labels = label_regions(grid.reshape(-1, n_cols), connectivity).ravel()
        sizes = np.bincount(labels)
        good = (labels > 0) & (sizes[labels] >= min_size)
        return pd.DataFrame({BY: pdf[BY], "pixel": pdf["pixel"], "included": good[pdf["pixel"]]})

    return masks.select(BY, "pixel", "included").groupBy(BY).applyInPandas(keep, f"{BY} long, pixel int, included boolean")


def watershed(amplitude: np.ndarray) -> np.ndarray:
    """Basins of the negated grid, seeded at local maxima, grown over eight neighbours from high to low."""
    labels = np.zeros(amplitude.shape, int)
    order = np.argsort(-amplitude, axis=None, kind="stable")
    number = 0
    for flat in order:
        r, c = np.unravel_index(flat, amplitude.shape)
        near = labels[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
        high = amplitude[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
        if near.any():
            labels[r, c] = near.ravel()[np.argmax(np.where(near > 0, high, -np.inf))]
        else:
            number += 1
            labels[r, c] = number
    return labels


def watershed_lungspace(amplitude: DataFrame, tiv: DataFrame, threshold: float = 0.15, n_cols: int = 8) -> DataFrame:
    """(recording_id, pixel, included): basins whose top passes the variation threshold, within the amplitude mask (our definition).

    ``amplitude`` and ``tiv`` are (recording_id, pixel, mean).
    """
    both = amplitude.select(BY, "pixel", F.col("mean").alias("amplitude")).join(tiv.select(BY, "pixel", F.col("mean").alias("tiv")), [BY, "pixel"])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel")
        a, t = pdf["amplitude"].to_numpy(), pdf["tiv"].to_numpy()
        labels = watershed(a.reshape(-1, n_cols)).ravel()
        good = np.zeros(labels.max() + 1, bool)
        for k in range(1, len(good)):
            inside = np.flatnonzero(labels == k)
            good[k] = t[inside[np.argmax(a[inside])]] >= threshold * t.max()
        return pd.DataFrame({BY: pdf[BY], "pixel": pdf["pixel"], "included": good[labels] & (a >= threshold * a.max())})

    return both.groupBy(BY).applyInPandas(keep, f"{BY} long, pixel int, included boolean")


def partly_missing(frames: DataFrame) -> DataFrame:
    """(recording_id, pixel, n_missing, n_frames) of pixels that are missing in some of a recording's frames, but not in all."""
    z = frames.select("recording_id", F.posexplode(F.col("pixels").cast("array<double>")).alias("pixel", "z"))
    gone = F.col("z").isNull() | F.isnan("z")
    counts = z.groupBy("recording_id", "pixel").agg(F.count_if(gone).alias("n_missing"), F.count(F.lit(1)).alias("n_frames"))
    return counts.where("n_missing > 0 AND n_missing < n_frames")


def filter_preserving_gaps(frames: DataFrame, kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4, strict: bool = True, keep_short: bool = False, length: int = 4096) -> DataFrame:
    """Frames with each pixel filtered forward and backward where it was measured; what wasn't stays missing.

    A filter can't span a gap.  ``strict``: a pixel that is missing in part of a recording is an error, as it would have to be
    repaired first.  Otherwise each run of measured frames is filtered by itself, and runs too short for it
    become missing, or stay unfiltered if ``keep_short``.  Long recordings are filtered in chunks.
    """
    if strict:
        found = partly_missing(frames).limit(5).collect()
        if found:
            raise ValueError(f"pixels are missing in part of a recording, such as {[(r.recording_id, r.pixel) for r in found]}; repair or drop them first")
    sections = iir.butterworth(order, cutoff, fs, kind)
    least = iir.edge(sections) + 1
    return chunks.map_frames(frames, lambda idx, grid: gaps.filter_runs(grid, lambda x: iir.zero_phase(sections, x), least, keep_short), length, chunks.settled(sections))
