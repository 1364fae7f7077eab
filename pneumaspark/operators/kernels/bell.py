"""Gaussians fitted to many breaths at once, by Gauss-Newton steps."""

from __future__ import annotations

import numpy as np

#: Numbers of one block of breaths, padded to one length.
BLOCK_VALUES = 1 << 19
STEPS = 50


def _steps(j: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """The least-squares steps of many breaths; directions that are singular to rounding aren't taken."""
    normal = j.transpose(0, 2, 1) @ j + 1e-9 * np.eye(3)
    right = (j.transpose(0, 2, 1) @ miss[:, :, None])[:, :, 0]
    good = np.isfinite(normal).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
    u, w, v = np.linalg.svd(np.where(good[:, None, None], normal, np.eye(3)))
    inverse = np.where(w > 3 * np.finfo(float).eps * w[:, :1], 1 / w, 0.0)
    step = (v.transpose(0, 2, 1) @ (inverse * (u.transpose(0, 2, 1) @ right[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
    return np.where(good[:, None], step, np.nan)


def _block(x: np.ndarray, y: np.ndarray, there: np.ndarray, peak: np.ndarray, fs: float) -> np.ndarray:
    n = there.sum(axis=1)
    y = np.where(there, y - np.where(there, y, np.inf).min(axis=1)[:, None], 0.0)
    a, m = np.maximum(y.max(axis=1), 1e-12), peak.astype(float)
    s = np.maximum((x[np.arange(len(x)), n - 1] - x[:, 0]) / 4, 0.5)
    going = np.flatnonzero(np.isfinite(y).all(axis=1))
    for _ in range(STEPS):
        if not len(going):
            break
        d, A, S = x[going] - m[going, None], a[going, None], s[going, None]
        e = np.where(there[going], np.exp(-(d**2) / (2 * S * S)), 0.0)
        step = _steps(np.stack([e, A * e * d / S**2, A * e * d**2 / S**3], axis=2), y[going] - A * e)
        a[going] += step[:, 0]
        m[going] += step[:, 1]
        s[going] = np.maximum(np.abs(s[going] + step[:, 2]), 0.1)
        going = going[~(np.abs(step).max(axis=1) < 1e-9) & np.isfinite(step).all(axis=1)]
    d = x - m[:, None]
    miss = np.abs(y - a[:, None] * np.exp(-(d**2) / (2 * s * s)[:, None]))
    steps = there[:, 1:]
    missed, whole = (((v[:, 1:] + v[:, :-1]) / 2 * steps).sum(axis=1) / fs for v in (miss, y))
    return np.where(whole > 0, 100 * missed / np.where(whole > 0, whole, 1.0), np.nan)


def errors(x: np.ndarray, y: np.ndarray, starts: np.ndarray, peak: np.ndarray, fs: float) -> np.ndarray:
    """Percent of its area by which each breath misses its fitted Gaussian; NaN where there is no area, a value is missing or the fit breaks off.

    Breaths lie one after another in ``x`` (places, rising) and ``y``, each from its start to the next one's.
    Those of like lengths are fitted together, so memory is bounded by a block, or by the longest breath.
    """
    lengths = np.diff(np.append(starts, len(x)))
    out = np.full(len(starts), np.nan)
    classes = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(int))
    with np.errstate(all="ignore"):
        for width in np.unique(classes[lengths > 0]).tolist():
            members = np.flatnonzero((classes == width) & (lengths > 0))
            size = max(1, BLOCK_VALUES // width)
            for k in range(0, len(members), size):
                b = members[k : k + size]
                there = np.arange(width) < lengths[b, None]
                at = np.where(there, starts[b, None] + np.arange(width), starts[b, None])
                out[b] = _block(x[at], y[at], there, peak[b], fs)
    return out
