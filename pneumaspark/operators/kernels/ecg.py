"""Heart-beat removal: template subtraction, gating and wavelet shrinkage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pneumaspark.operators.kernels import iir, peaks


def ecg_peaks(x: np.ndarray, fs: float, fraction: float = 0.4, width: float | None = None, distance: float | None = None, band: bool = True) -> np.ndarray:
    """Peaks over a share of the range, at least a third of a second apart."""
    if band and fs > 4:
        x = iir.zero_phase(iir.butterworth(2, (1.0, min(500.0, 0.95 * fs / 2)), fs, "bandpass"), x)
    height = x.min() + fraction * (x.max() - x.min())
    return peaks.find(x, height=height, width=width or max(1, fs / 1000), distance=distance or max(1, fs / 3))


def gate(x: np.ndarray, at: np.ndarray, width: int = 205, fill: int = 1) -> np.ndarray:
    """Replace a gate around each peak: 0 zeros, 1 a line, 2 the mean of the segment before (else after), 3 the running RMS of ungated samples."""
    y = np.asarray(x, float).copy()
    gates = [(max(0, int(p - width / 2) if fill == 3 else p - width // 2), min(len(y), int(p + width / 2) if fill == 3 else p + width // 2)) for p in at]
    mask = np.zeros(len(y), bool)
    for a, b in gates:
        mask[a:b] = True
    if fill == 3:
        keep = np.where(mask, 0.0, y**2)
        half = width
        total, count = np.cumsum(np.append(0, keep)), np.cumsum(np.append(0, ~mask))
        lo, hi = np.maximum(np.arange(len(y)) - half, 0), np.minimum(np.arange(len(y)) + half + 1, len(y))
        rms = np.sqrt((total[hi] - total[lo]) / np.maximum(count[hi] - count[lo], 1))
        return np.where(mask, rms, y)
    for a, b in gates:
        if b <= a:
            continue
        if fill == 0:
            y[a:b] = 0
        elif fill == 1:
            left, right = y[a - 1] if a else y[min(b, len(y) - 1)], y[b] if b < len(y) else y[a - 1] if a else 0.0
            y[a:b] = left + (right - left) * np.arange(1, b - a + 1) / (b - a + 1)
        else:
            before, after = y[max(0, a - width) : a], y[b : b + width]
            y[a:b] = before.mean() if len(before) else after.mean() if len(after) else 0.0
    return y


# ---- estimated ECG subtraction


@dataclass(frozen=True)
class Subtraction:
    """What a subtraction found; places are indices of the signal, ``qrs`` has Q, R and S of each beat of the template."""

    cleaned: np.ndarray
    estimate: np.ndarray
    detection: np.ndarray
    threshold: np.ndarray
    candidates: np.ndarray
    peaks: np.ndarray
    rejected: np.ndarray
    restored: np.ndarray
    qrs: np.ndarray
    template: np.ndarray


#: Beats whose Q-R or R-S scale is below this share of the median scale aren't averaged: their Q or S lies wrong.
LEAST_SCALE = 0.25


def smooth(x: np.ndarray, width: int) -> np.ndarray:
    """Centred mean over an odd width, at most the signal's; ends are repeated."""
    width += 1 - width % 2
    if width > len(x):
        width = (len(x) - 1) // 2 * 2 + 1
    return np.convolve(np.pad(x, width // 2, mode="edge"), np.full(width, 1 / width), "valid")


def midrange(x: np.ndarray, interval: int, smoothing: int) -> np.ndarray:
    """A threshold that follows the signal: the middle between least and greatest of each interval, on lines between the intervals' centres."""
    starts = np.arange(0, len(x), interval)
    ends = np.minimum(starts + interval, len(x))
    middle = (np.minimum.reduceat(x, starts) + np.maximum.reduceat(x, starts)) / 2
    return smooth(np.interp(np.arange(len(x)), (starts + ends - 1) / 2, middle), smoothing)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches where the mask holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def run_tops(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The first place of the greatest value of each run: of all places sorted by run and falling value, each run's first."""
    starts, ends = runs(mask)
    on = np.flatnonzero(mask)
    run = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((on, -x[on], run))
    first = np.concatenate(([True], run[order][1:] != run[order][:-1])) if len(on) else np.empty(0, bool)
    return on[order][first]


def steady_beats(tops: np.ndarray, strength: np.ndarray, threshold: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(peaks, rejected, restored): of two beats too close, the stronger stays; a beat that is missing is looked for where it is expected.

    Too close is under 1 - tolerance of the median interval, missing over 1 + tolerance of it, counted anew.
    """
    tops = np.unique(tops)
    period = float(np.median(np.diff(tops)))
    least = max(1.0, (1 - tolerance) * period)
    kept = tops[:1].tolist()
    for place in tops[1:].tolist():
        if place - kept[-1] >= least:
            kept.append(place)
        elif strength[place] > strength[kept[-1]]:
            kept[-1] = place
    rejected = np.setdiff1d(tops, kept)
    if len(kept) > 1:
        period = float(np.median(np.diff(kept)))
    found: list[int] = []

    def expected(place: int, before: int) -> int | None:
        """The strongest place over the threshold around a period after ``place``, before the next beat."""
        a = max(place + 1, round(place + period - tolerance * period))
        b = min(before, round(place + period + tolerance * period) + 1)
        over = a + np.flatnonzero(strength[a:b] > threshold[a:b]) if b > a else np.empty(0, int)
        return int(over[np.argmax(strength[over])]) if len(over) else None

    for place, following in zip(kept[:-1], kept[1:], strict=True):
        while following - place > (1 + tolerance) * period:
            place = expected(place, following)
            if place is None:
                break
            found.append(place)
    return np.array(sorted([*kept, *found])), rejected, np.array(found, int)


def qrs_complexes(x: np.ndarray, peaks: np.ndarray, over: np.ndarray, half: int) -> np.ndarray:
    """(Q, R, S) rows: the top of each peak's run over the threshold, strictly inside it, and the lows on both sides; whole windows only."""
    starts, ends = runs(over)
    rows = []
    for k in np.searchsorted(starts, peaks, side="right") - 1:
        a, b = int(starts[k]), int(ends[k])
        r = a + int(np.argmax(x[a:b]))
        if b - a < 3 or not a < r < b - 1 or r - half < 0 or r + half + 1 > len(x):
            continue
        rows.append((a + int(np.argmin(x[a:r])), r, r + 1 + int(np.argmin(x[r + 1 : b]))))
    qrs = np.array(rows, int).reshape(-1, 3)
    q, r, s = x[qrs].T if len(qrs) else np.empty((3, 0))
    tiny = np.finfo(float).eps
    qrs = qrs[(r - q > tiny) & (r - s > tiny)]
    if not len(qrs):
        return qrs
    q, r, s = x[qrs].T
    return qrs[(r - q >= LEAST_SCALE * np.median(r - q)) & (r - s >= LEAST_SCALE * np.median(r - s))]


def estimate_ecg(x: np.ndarray, qrs: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, template): the mean beat, scaled from Q to R before its top and from S to R after it, put back at each beat; overlaps are averaged."""
    level = x[qrs]
    around = qrs[:, 1:2] + np.arange(-half, half + 1)
    after = np.arange(-half, half + 1) >= 0
    foot = np.where(after, level[:, 2:], level[:, :1])
    scale = level[:, 1:2] - foot
    template = ((x[around] - foot) / scale).mean(axis=0)
    total, count = np.zeros(len(x)), np.zeros(len(x))
    np.add.at(total, around, template * scale + foot)
    np.add.at(count, around, 1)
    return np.divide(total, count, out=np.zeros(len(x)), where=count > 0), template


POOR_SIGNAL = "a signal of three finite samples or more, not all alike, is needed"


@dataclass(frozen=True)
class Settings:
    """Settings of ``estimated_subtraction``; times in seconds."""

    band: tuple[float, float] = (4.0, 50.0)
    order: int = 4
    smoothing: float = 0.0167
    interval: float = 0.5
    threshold_smoothing: float = 0.0125
    window: float = 0.3
    tolerance: float = 0.66
    fewest: int = 3
    shortest: float | None = 0.25
    longest: float | None = 2.0
    output_band: tuple[float, float] | None = None
    output_stage: str = "after_subtraction"
    output_order: int = 4

    def check(self, fs: float) -> None:
        """Raise ValueError for settings that make no sense."""
        for name, pair in (("band", self.band), ("output_band", self.output_band)):
            if pair is not None and not 0 < pair[0] < pair[1] < fs / 2:
                raise ValueError(f"{name} must rise and lie between 0 and half the sampling rate")
        if not 0 <= self.tolerance < 1 or min(self.smoothing, self.interval, self.threshold_smoothing, self.window, fs) <= 0 or self.fewest < 1 or min(self.order, self.output_order) < 1:
            raise ValueError("times, orders and counts must be positive, the tolerance from 0 to below 1")
        if self.output_stage not in ("before_subtraction", "after_subtraction"):
            raise ValueError(f"unknown output stage {self.output_stage!r}")
        if min(self.shortest or 1, self.longest or 1) <= 0 or (self.shortest and self.longest and self.shortest >= self.longest):
            raise ValueError("the shortest interval must be positive and below the longest")

    @staticmethod
    def samples(fs: float, seconds: float) -> int:
        return max(1, round(seconds * fs))


def estimated_subtraction(x: np.ndarray, fs: float, **how) -> Subtraction:
    """Estimate the repeating ECG in a muscle signal and subtract it, by ``Settings``.

    Beats are the tops of the rectified, smoothed band where it exceeds ``midrange``; their period is made steady, their
    complexes averaged (``estimate_ecg``).  ``output_band`` filters the signal before, or the result
    after the subtraction.  Raises ValueError with fewer than ``fewest`` beats or complexes, for a median interval of complexes
    outside ``shortest`` to ``longest``, and for settings that make no sense.  ``operators.heartbeats`` does the same by chunk.
    """
    x, s = np.asarray(x, float), Settings(**how)
    if x.ndim != 1 or len(x) < 3 or not np.all(np.isfinite(x)) or np.ptp(x) <= np.finfo(float).eps:
        raise ValueError(POOR_SIGNAL)
    s.check(fs)

    def n(seconds: float) -> int:
        return s.samples(fs, seconds)

    detection = smooth(np.abs(iir.zero_phase(iir.butterworth(s.order, s.band, fs, "bandpass"), x)), n(s.smoothing)) / np.ptp(x)
    threshold = midrange(detection, n(s.interval), n(s.threshold_smoothing))
    over = detection > threshold
    candidates = run_tops(detection, over)
    if len(candidates) < max(s.fewest, 2):
        raise ValueError(f"{len(candidates)} beats were found; {s.fewest} are needed")
    peaks_, rejected, restored = steady_beats(candidates, detection, threshold, s.tolerance)
    half = n(s.window) // 2
    qrs = qrs_complexes(x, peaks_, over, half)
    if len(qrs) < s.fewest:
        raise ValueError(f"{len(qrs)} whole QRS complexes were found; {s.fewest} are needed")
    if len(qrs) > 1:
        seconds = float(np.median(np.diff(qrs[:, 1]))) / fs
        if (s.shortest is not None and seconds < s.shortest) or (s.longest is not None and seconds > s.longest):
            raise ValueError(f"a median interval of {seconds:.3f} s between beats isn't plausible")
    estimate, template = estimate_ecg(x, qrs, half)
    out = None if s.output_band is None else iir.butterworth(s.output_order, s.output_band, fs, "bandpass")
    if out is not None and s.output_stage == "before_subtraction":
        cleaned = iir.zero_phase(out, x) - estimate
    else:
        cleaned = x - estimate if out is None else iir.zero_phase(out, x - estimate)
    return Subtraction(cleaned, estimate, detection, threshold, candidates, peaks_, rejected, restored, qrs, template)


DB2 = np.array([1 + np.sqrt(3), 3 + np.sqrt(3), 3 - np.sqrt(3), 1 - np.sqrt(3)]) / (4 * np.sqrt(2))


def wavelet_denoise(x: np.ndarray, at: np.ndarray, width: int, levels: int = 4, factor: float = 4.5, hard: bool = True) -> np.ndarray:
    """Undecimated db2 transform (periodic); large coefficients inside the gates are taken away, and the rest put together again."""
    n = len(x)
    size = -(-n // 2**levels) * 2**levels
    a = np.pad(np.asarray(x, float), (0, size - n), "symmetric")
    mask = np.zeros(size, bool)
    for p in at:
        mask[max(0, p - width // 2) : p + width // 2] = True
    low, high = DB2 / np.sqrt(2), (DB2[::-1] * np.array([1, -1, 1, -1])) / np.sqrt(2)
    f = np.fft.fft
    details = []
    for k in range(levels):
        h, g = (np.zeros(size) for _ in range(2))
        for j in range(4):
            h[(j << k) % size] += low[j]
            g[(j << k) % size] += high[j]
        spectrum = f(a)
        d = np.real(np.fft.ifft(spectrum * f(g)))
        a = np.real(np.fft.ifft(spectrum * f(h)))
        limit = factor * np.median(np.abs(d)) / 0.6745
        big = mask & (np.abs(d) > limit)
        d = np.where(big, 0.0 if hard else np.sign(d) * limit, d)
        details.append((d, f(h), f(g)))
    for d, h, g in reversed(details):
        a = np.real(np.fft.ifft(f(a) * np.conj(h) + f(d) * np.conj(g)))
    return a[:n]
