"""The shift at which two recordings of one quantity are most alike."""

from __future__ import annotations

import numpy as np

from pneumaspark.operators.kernels import iir


def without_end(x: np.ndarray) -> np.ndarray:
    """A signal without missing samples at its end; one inside is an error."""
    there = np.flatnonzero(np.isfinite(x))
    x = np.asarray(x, float)[: there[-1] + 1] if len(there) else np.empty(0)
    if not np.all(np.isfinite(x)):
        raise ValueError("the signal has missing samples inside")
    return x


def shifted_correlations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shifts, coefficients, overlap): the correlation of ``a`` with ``b[shift:]`` where they overlap, for every shift.

    Products come from one transform; sums of each overlap are differences of running sums.
    """
    m, n = len(a), len(b)
    shifts = np.arange(1 - m, n)
    a, b = a - a.mean(), b - b.mean()  # keeps the sums small; coefficients don't change
    size = 1 << (m + n - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    product = np.concatenate((product[size - m + 1 :], product[:n]))
    first_a, first_b = np.maximum(-shifts, 0), np.maximum(shifts, 0)
    overlap = np.minimum(m - first_a, n - first_b)

    def total(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0.0], np.cumsum(x)))
        return run[first + overlap] - run[first]

    sa, sb = total(a, first_a), total(b, first_b)
    va, vb = total(a * a, first_a) - sa**2 / overlap, total(b * b, first_b) - sb**2 / overlap
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (product - sa * sb / overlap) / np.sqrt(va * vb)
    return shifts, np.where((va > 1e-12 * max(1e-300, np.dot(a, a))) & (vb > 1e-12 * max(1e-300, np.dot(b, b))), r, np.nan), overlap


def clock_offset(
    reference: np.ndarray, reference_fs: float, other: np.ndarray, other_fs: float, window: tuple[float, float],
    begins: float = 0.0, lowpass_hz: float = 8.0, margin: float = 20.0, search: float = 30.0, coarse_hz: float = 100.0, fine: float = 0.001,
) -> tuple[float, float]:
    """(offset, correlation): when the other recording's first sample was taken, on the reference's clock.

    Both are low-passed; of the reference only the window and a margin around it counts, and the
    other one has to cover the window.  First every shift of a coarse step, then fine steps around the best.
    ``begins``: the time of the reference's first sample.
    """
    x, y = without_end(reference), without_end(other)
    x, y = (iir.zero_phase(iir.butterworth(2, lowpass_hz, fs, "lowpass"), v) if lowpass_hz < fs / 2 else v for v, fs in ((x, reference_fs), (y, other_fs)))
    tx, ty = begins + np.arange(len(x)) / reference_fs, np.arange(len(y)) / other_fs
    start, end = max(tx[0], window[0] - margin), min(tx[-1], window[1] + margin)
    at = start + np.arange(int((end - start) * coarse_hz)) / coarse_hz
    part = np.interp(at, tx, x)
    grid = np.interp(np.arange(int(ty[-1] * coarse_hz) + 1) / coarse_hz, ty, y)
    shifts, r, overlap = shifted_correlations(part, grid)
    offsets = start - shifts / coarse_hz
    allowed = (np.abs(offsets) <= search) & (offsets <= window[0]) & (offsets + ty[-1] >= window[1]) & (overlap > 1) & np.isfinite(r)
    if not allowed.any():
        raise ValueError("the other recording doesn't cover the window")
    best = offsets[allowed][np.argmax(r[allowed])]
    tries = []
    for offset in best + fine * np.arange(-20, 21):
        inside = (at - offset >= 0) & (at - offset <= ty[-1])
        there = np.interp(at[inside] - offset, ty, y)
        tries.append((float(np.corrcoef(part[inside], there)[0, 1]), round(float(offset), 6)))
    correlation, offset = max(tries, key=lambda t: t[0])
    return offset, correlation
