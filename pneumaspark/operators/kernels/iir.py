"""Butterworth and notch filters, forward and backward, from the bilinear transform.

A filter is a list of second-order sections (b0, b1, b2, a1, a2).
"""

from __future__ import annotations

import numpy as np


def _pair(z: np.ndarray) -> list[tuple[complex, complex]]:
    """Conjugate pairs, then real ones two by two."""
    up = [c for c in z if c.imag > 1e-9]
    real = sorted((c.real for c in z if abs(c.imag) <= 1e-9), key=abs)
    pairs = [(c, c.conjugate()) for c in sorted(up, key=abs)]
    pairs += [(real[k], real[k + 1]) for k in range(0, len(real) - 1, 2)]
    return pairs + ([(real[-1], None)] if len(real) % 2 else [])


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter: lowpass, highpass, bandpass or bandstop."""
    if isinstance(order, bool) or not isinstance(order, int) or order < 1:
        raise ValueError("the order must be a positive integer")
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if len(edges) != (2 if kind in ("bandpass", "bandstop") else 1) or not np.all((edges > 0) & (edges < fs / 2)) or np.any(np.diff(edges) <= 0):
        raise ValueError(f"bad cutoff {cutoff!r} for {kind} at {fs} Hz")
    w = 2 * fs * np.tan(np.pi * edges / fs)
    k = np.arange(order)
    p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))  # unit circle, left half
    z = np.empty(0, complex)
    gain = 1.0
    if kind == "lowpass":
        p, gain = p * w[0], w[0] ** order
    elif kind == "highpass":
        gain = np.real(1 / np.prod(-p))
        z, p = np.zeros(order, complex), w[0] / p
    else:
        band, mid = w[1] - w[0], np.sqrt(w[0] * w[1])
        if kind == "bandpass":
            half = p * band / 2
            z, gain = np.zeros(order, complex), band**order
        else:
            half = band / 2 / p
            z = np.concatenate([np.full(order, 1j * mid), np.full(order, -1j * mid)])
            gain = np.real(1 / np.prod(-p))
        root = np.sqrt(half**2 - mid**2)
        p = np.concatenate([half + root, half - root])
    c = 2 * fs
    gain *= np.real(np.prod(c - z) / np.prod(c - p))
    zd = np.concatenate([(c + z) / (c - z), -np.ones(len(p) - len(z))])
    pd = (c + p) / (c - p)
    sections = []
    for poles, zeros in zip(_pair(pd), _pair(zd), strict=True):
        a = np.real(np.poly([x for x in poles if x is not None]))
        b = np.real(np.poly([x for x in zeros if x is not None]))
        sections.append([*np.pad(b, (0, 3 - len(b))), *np.pad(a[1:], (0, 3 - len(a)))])
    out = np.array(sections)
    out[0, :3] *= gain
    return out


def notch(frequency: float, fs: float, quality: float) -> np.ndarray:
    """One section with a zero on the unit circle at ``frequency`` and a -3 dB width of frequency / quality."""
    if not 0 < frequency < fs / 2:
        raise ValueError("the frequency must lie below half the sampling rate")
    w0 = 2 * np.pi * frequency / fs
    beta = np.tan(w0 / quality / 2)
    gain = 1 / (1 + beta)
    return np.array([[gain, -2 * gain * np.cos(w0), gain, -2 * gain * np.cos(w0), 2 * gain - 1]])


def _settled(section: np.ndarray) -> np.ndarray:
    """State of a section (direct form II transposed) that has seen ones forever."""
    b0, b1, b2, a1, a2 = section
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([y - b0, b2 - a2 * y])


#: Samples that are filtered at once.
BLOCK = 64


def _blocked(section: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One section over whole blocks: what each block answers from rest, plus what is left of the state before it.

    A block's answer is a product with the lower triangle of the impulse response; only the
    two numbers of the state go from block to block.
    """
    b0, b1, b2, a1, a2 = section.tolist()
    # impulse response, and the answer to a state of (1, 0); that of (0, 1) is the same one sample later
    h, free, s = np.empty(BLOCK), np.empty(BLOCK + 1), [0.0, 0.0]
    for k in range(BLOCK):
        o = (b0 if k == 0 else 0.0) + s[0]
        s = [(b1 if k == 0 else 0.0) - a1 * o + s[1], (b2 if k == 0 else 0.0) - a2 * o]
        h[k] = o
    s = [1.0, 0.0]
    for k in range(BLOCK + 1):
        free[k] = s[0]
        s = [-a1 * s[0] + s[1], -a2 * s[0]]
    apart = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    answer = np.where(apart >= 0, h[np.abs(apart)], 0.0)
    later = np.concatenate(([0.0], free[: BLOCK - 1]))
    rows = x.reshape(-1, BLOCK)
    rest = rows @ answer.T
    # the state after a block from rest: the direct form's sums of its last two samples
    z2 = b2 * rows[:, -1] - a2 * rest[:, -1]
    z1 = b1 * rows[:, -1] - a1 * rest[:, -1] + b2 * rows[:, -2] - a2 * rest[:, -2]
    # and what a state leaves of itself after a block
    f1, f2 = free[:BLOCK], later
    m11, m12 = -a1 * f1[-1] - a2 * f1[-2], -a1 * f2[-1] - a2 * f2[-2]
    m21, m22 = -a2 * f1[-1], -a2 * f2[-1]
    states = np.empty((len(rows), 2))
    p, q = z.tolist()
    for k, (u, v) in enumerate(zip(z1.tolist(), z2.tolist(), strict=True)):
        states[k] = p, q
        p, q = m11 * p + m12 * q + u, m21 * p + m22 * q + v
    z[:] = p, q
    return (rest + np.outer(states[:, 0], f1) + np.outer(states[:, 1], f2)).ravel()


def run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter once, starting settled at the first sample."""
    y, level = np.asarray(x, float), float(x[0])
    for s in sections:
        b0, b1, b2, a1, a2 = s.tolist()
        z = _settled(s) * level
        cut = len(y) - len(y) % BLOCK
        head = _blocked(s, np.ascontiguousarray(y[:cut]), z) if cut else np.empty(0)
        z1, z2 = z.tolist()
        out = []
        for v in y[cut:].tolist():
            o = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
            out.append(o)
        y = np.concatenate((head, out))
        level *= (b0 + b1 + b2) / (1 + a1 + a2)
    return y


def edge(sections: np.ndarray) -> int:
    """Samples by which a signal is extended at both ends; it has to have more."""
    return int(3 * (2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 4] == 0).sum())))


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over the signal extended by odd reflection at both ends."""
    x = np.asarray(x, float)
    if not np.all(np.isfinite(x)):
        raise ValueError("the signal has missing values")
    n = edge(sections)
    if len(x) <= n:
        raise ValueError(f"the signal needs more than {n} samples")
    padded = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    y = run(sections, run(sections, padded)[::-1])[::-1]
    return y[n:-n]


def harmonics(base: float, fs: float, top: float | None = None, distance: float | None = None, order: int = 4, quality: float = 30.0) -> list[np.ndarray]:
    """A notch, or a band-stop of +- distance, for every multiple of ``base`` strictly below the top and half the rate."""
    limit = min(top or fs / 2, fs / 2)
    places = [k * base for k in range(1, int(limit / base) + 2) if k * base < limit]
    return [butterworth(order, (f - distance, f + distance), fs, "bandstop") if distance else notch(f, fs, quality) for f in places]


def harmonic_notch(x: np.ndarray, base: float, fs: float, top: float | None = None, distance: float | None = None, order: int = 4, quality: float = 30.0) -> np.ndarray:
    """``harmonics`` one after another."""
    for sections in harmonics(base, fs, top, distance, order, quality):
        x = zero_phase(sections, x)
    return x
