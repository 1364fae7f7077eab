"""Rolling statistics over arrays, with windows cut short at the ends and NaN skipped.

Windows of position i hold i - before to i + after.  Blocks of windows are reduced at once as views of
the array, so memory is bounded and no sum is carried along (a flat stretch stays exactly
flat); percentiles at every position keep the window sorted instead.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np

#: Values of a block of windows.
BLOCK_VALUES = 1 << 22


def blocks(x: np.ndarray, before: int, after: int) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(first, end, windows, whether some value is missing) of consecutive positions."""
    padded = np.concatenate((np.full(before, np.nan), np.asarray(x, float), np.full(after, np.nan)))
    views = np.lib.stride_tricks.sliding_window_view(padded, before + after + 1)
    step = max(1, BLOCK_VALUES // views.shape[1])
    missing = np.isnan(padded)
    for a in range(0, len(views), step):
        b = min(a + step, len(views))
        yield a, b, views[a:b], bool(missing[a : b + before + after].any())


def reduced(x: np.ndarray, before: int, after: int, plain: Callable, skipping: Callable) -> np.ndarray:
    """A reduction of every window: ``plain(windows, axis=1)``, or ``skipping`` where values are missing."""
    out = np.empty(len(x))
    for a, b, w, gaps in blocks(x, before, after):
        out[a:b] = (skipping if gaps else plain)(w, axis=1)
    return out


def _quiet(f: Callable) -> Callable:
    """Windows without a value give NaN, not a warning."""

    def g(w: np.ndarray, axis: int) -> np.ndarray:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            return f(w, axis=axis)

    return g


def sums(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return reduced(x, before, after, np.sum, np.nansum)


def means(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return reduced(x, before, after, np.mean, _quiet(np.nanmean))


def deviations(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Population standard deviation."""
    return reduced(x, before, after, np.std, _quiet(np.nanstd))


def rms(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return np.sqrt(means(np.asarray(x, float) ** 2, before, after))


def arv(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return means(np.abs(x), before, after)


def _between(ordered, n: int, share: float) -> float:
    """The value at a share of the way through ``n`` sorted values, on a line between two."""
    place = (n - 1) * share
    low = int(place)
    a = ordered[low]
    return a + (ordered[min(low + 1, n - 1)] - a) * (place - low)


def percentile_at(x: np.ndarray, at: np.ndarray, before: int, after: int, percentile: float) -> np.ndarray:
    """The percentile of the windows around some positions; NaN where a window has no value.

    Whole windows are split at the two ranks, many at once; only those cut at an end or with missing
    values are taken one by one.
    """
    x, out, share, width = np.asarray(x, float), np.full(len(at), np.nan), percentile / 100, before + after + 1
    at = np.asarray(at, np.int64)
    missing = np.concatenate(([0], np.cumsum(np.isnan(x))))
    low, high = np.maximum(at - before, 0), np.minimum(at + after + 1, len(x))
    whole = (high - low == width) & (missing[high] == missing[low])
    place = (width - 1) * share
    k = int(place)
    if whole.any():
        views = np.lib.stride_tricks.sliding_window_view(x, width)
        some = np.flatnonzero(whole)
        for a in range(0, len(some), max(1, BLOCK_VALUES // width)):
            these = some[a : a + max(1, BLOCK_VALUES // width)]
            parts = np.partition(views[low[these]], sorted({k, min(k + 1, width - 1)}), axis=1)
            out[these] = parts[:, k] + (parts[:, min(k + 1, width - 1)] - parts[:, k]) * (place - k)
    for j in np.flatnonzero(~whole).tolist():
        values = np.sort(x[low[j] : high[j]])
        n = int(np.count_nonzero(~np.isnan(values)))
        if n:
            out[j] = _between(values, n, share)
    return out


def running_percentile(x: np.ndarray, before: int, after: int, percentile: float) -> np.ndarray:
    """The percentile of every window, from one sorted window that a value enters and one leaves at each step."""
    values, out, share = np.asarray(x, float).tolist(), np.full(len(x), np.nan), percentile / 100
    held: list[float] = []
    for v in values[: min(after, len(values))]:
        if v == v:
            insort(held, v)
    for i in range(len(values)):
        new, old = i + after, i - before - 1
        if new < len(values) and values[new] == values[new]:
            insort(held, values[new])
        if old >= 0 and values[old] == values[old]:
            del held[bisect_left(held, values[old])]
        if held:
            out[i] = _between(held, len(held), share)
    return out


def moving_baseline(idx: np.ndarray, x: np.ndarray, window: int, step: int, percentile: float) -> np.ndarray:
    """A percentile around each step's first sample, held over the step; NaN before the first one."""
    anchors = np.flatnonzero(idx % step == 0)
    held = percentile_at(x, anchors, window // 2, window // 2, percentile)
    last = np.searchsorted(idx[anchors], idx - idx % step)
    found = (last < len(anchors)) & (idx[anchors[np.minimum(last, len(anchors) - 1)]] == idx - idx % step) if len(anchors) else np.zeros(len(idx), bool)
    return np.where(found, held[np.minimum(last, len(anchors) - 1)] if len(anchors) else np.nan, np.nan)


def slopesum_baseline(idx: np.ndarray, x: np.ndarray, window: int, step: int, average: int, near: int, percentile: float, augmented: float) -> dict[str, np.ndarray]:
    """See ``windows.slopesum_baseline``."""
    slope = np.nan_to_num(np.abs(np.diff(x, prepend=x[:1])))
    slope_sum = sums(slope, average // 2, (average - 1) // 2)
    limit = running_percentile(slope_sum, near // 2, (near - 1) // 2, augmented)
    quiet = np.where(slope_sum <= limit, x, np.nan)
    held, plain = (moving_baseline(idx, v, window, step, percentile) for v in (quiet, x))
    around = (near // 2, (near - 1) // 2)
    return {"slope_sum": slope_sum, "baseline": np.where(np.isnan(held), plain, held), "running_mean": means(x, *around), "running_std": deviations(x, *around)}
