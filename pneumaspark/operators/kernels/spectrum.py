"""Welch spectra, power loss and rate detection."""

from __future__ import annotations

import numpy as np


def welch(x: np.ndarray, fs: float, segment: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): mean periodogram of Hann-weighted segments without their means."""
    x = np.asarray(x, float)
    segment = min(segment, len(x))
    overlap = min(overlap, segment - 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = [x[a : a + segment] for a in range(0, len(x) - segment + 1, segment - overlap)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0) / (fs * (window**2).sum())
    power[1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), power


def power_loss(original: np.ndarray, processed: np.ndarray, fs_original: float, fs_processed: float, segment: int | None = None, percent: float = 25) -> float:
    """100 (1 - power kept); the overlap is a share of the rate, not of the segment."""
    total = [welch(x, fs, segment or int(fs) // 2, int(percent / 100 * fs))[1].sum() for x, fs in ((original, fs_original), (processed, fs_processed))]
    return 100 * (1 - total[1] / total[0])


def peak_rate(f: np.ndarray, power: np.ndarray, low: float, high: float) -> float:
    """Frequency of the greatest power in a band, refined by a parabola; NaN where the band is empty."""
    inside = np.flatnonzero((f >= low) & (f <= high))
    if not len(inside):
        return float("nan")
    k = inside[np.argmax(power[inside])]
    if 0 < k < len(f) - 1:
        a, b, c = power[k - 1 : k + 2]
        bend = a - 2 * b + c
        return float(f[k] + (0.5 * (a - c) / bend if bend else 0.0) * (f[1] - f[0]))
    return float(f[k])


def detect_rates(pixels: np.ndarray, fs: float, subject: str = "adult", seconds: float = 30.0) -> tuple[float, float]:
    """(respiratory, heart) rate in Hz from the mean spectrum of pixel signals (time, pixel); our definition."""
    bands = {"adult": ((6, 60), (40, 200)), "neonate": ((15, 85), (90, 210))}[subject]
    n = int(seconds * fs)
    spectra = [welch(p, fs, n, n // 2) for p in np.atleast_2d(pixels.T)]
    f, power = spectra[0][0], np.mean([s[1] for s in spectra], axis=0)
    rr, hr = (peak_rate(f, power, low / 60, high / 60) for low, high in bands)
    return rr, hr
