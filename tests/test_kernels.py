"""Closed-form signals and invariants of the NumPy kernels."""

import numpy as np
import pytest

from pneumaspark.operators import filters
from pneumaspark.operators.kernels import ecg, iir, peaks, spectrum
from pneumaspark.operators.pixels import label_regions, watershed
from pneumaspark.operators.windows import student_t

FS = 100.0
T = np.arange(0, 20, 1 / FS)


def gain(sections, f):
    z = np.exp(-2j * np.pi * f / FS)
    return np.prod([abs((s[0] + s[1] * z + s[2] * z * z) / (1 + s[3] * z + s[4] * z * z)) for s in sections])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7])
def test_butterworth_gain(order):
    low = iir.butterworth(order, 10.0, FS, "lowpass")
    assert gain(low, 1e-6) == pytest.approx(1) and gain(low, 10.0) == pytest.approx(2**-0.5)
    high = iir.butterworth(order, 10.0, FS, "highpass")
    assert gain(high, FS / 2) == pytest.approx(1) and gain(high, 10.0) == pytest.approx(2**-0.5)
    for kind, inside in (("bandpass", 1.0), ("bandstop", 0.0)):
        both = iir.butterworth(order, (5.0, 20.0), FS, kind)
        middle = np.arctan(np.sqrt(np.tan(np.pi * 5 / FS) * np.tan(np.pi * 20 / FS))) * FS / np.pi
        assert gain(both, middle) == pytest.approx(inside, abs=1e-6)
        assert gain(both, 5.0) == pytest.approx(2**-0.5) and gain(both, 20.0) == pytest.approx(2**-0.5)


def test_zero_phase_keeps_slow_and_drops_fast():
    slow, fast = np.sin(2 * np.pi * 0.5 * T), np.sin(2 * np.pi * 30 * T)
    y = iir.zero_phase(iir.butterworth(4, 5.0, FS, "lowpass"), slow + fast)
    assert np.abs(y - slow)[100:-100].max() < 1e-3


def test_zero_phase_is_symmetric():
    x = np.zeros(401)
    x[200] = 1
    y = iir.zero_phase(iir.butterworth(3, 8.0, FS, "lowpass"), x)
    assert np.allclose(y, y[::-1], atol=1e-9)


def test_notch_and_harmonics():
    assert gain(iir.notch(10.0, FS, 30), 10.0) < 1e-9
    x = np.sin(2 * np.pi * 10 * T) + np.sin(2 * np.pi * 20 * T) + np.sin(2 * np.pi * 3 * T)
    y = iir.harmonic_notch(x, 10.0, FS)
    assert np.abs(y - np.sin(2 * np.pi * 3 * T))[500:-500].max() < 0.02


@pytest.mark.parametrize("bad", [(0, "lowpass", 4), (60.0, "lowpass", 4), ((20.0, 5.0), "bandpass", 4), (5.0, "lowpass", 0), (5.0, "lowpass", True)])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        iir.butterworth(bad[2], bad[0], FS, bad[1])


def test_missing_values_are_refused():
    with pytest.raises(ValueError):
        iir.zero_phase(iir.butterworth(2, 5.0, FS, "lowpass"), np.append(T, np.nan))


def test_power_loss_and_rates():
    x = np.sin(2 * np.pi * 0.25 * T) + 0.5 * np.sin(2 * np.pi * 1.2 * T)
    assert spectrum.power_loss(x, x, FS, FS) == pytest.approx(0)
    assert spectrum.power_loss(x, 0.5 * x, FS, FS) == pytest.approx(75)
    t = np.arange(0, 120, 1 / 20)
    rr, hr = spectrum.detect_rates((np.sin(2 * np.pi * 0.25 * t) + 0.3 * np.sin(2 * np.pi * 1.3 * t))[:, None], 20)
    assert rr == pytest.approx(0.25, abs=0.01) and hr == pytest.approx(1.3, abs=0.02)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 0.5, 0.0])
    assert peaks.maxima(x).tolist() == [1, 4, 7, 9]
    assert peaks.find(x, height=1.5).tolist() == [4, 7]
    assert peaks.find(x, distance=4).tolist() == [1, 7]
    assert peaks.find(x, prominence=1).tolist() == [1, 4, 7]
    assert peaks.find(-x, invert=True).tolist() == [1, 4, 7, 9]
    assert peaks.maxima(np.array([1.0, 1.0])).tolist() == []
    assert peaks.merge_close(np.array([1, 4, 7]), x, 4).tolist() == [1, 7] or peaks.merge_close(np.array([1, 4, 7]), x, 4).tolist() == [7]


def test_merge_close_is_greedy():
    x = np.zeros(20)
    x[[2, 4, 6, 15]] = [1, 3, 2, 1]
    assert peaks.merge_close(np.array([15, 2, 4, 6]), x, 3).tolist() == [4, 15]


def test_pressure_dips():
    t = np.arange(0, 60, 1 / FS)
    x = -0.3 + np.zeros(len(t))
    for k, centre in enumerate(np.arange(5, 56, 5)):
        near = np.abs(t - centre) < 0.75
        x[near] -= (0.5 + 0.2 * k) * np.cos(np.pi * (t[near] - centre) / 1.5) ** 2
    found = peaks.pressure_dips(x, FS) / FS
    assert np.allclose(found, np.arange(5, 56, 5), atol=0.05)
    x[480:520] = np.nan
    assert len(peaks.pressure_dips(x, FS)) == 10


def test_pressure_dips_without_finite_samples():
    assert peaks.pressure_dips(np.full(50, np.nan), FS).tolist() == [] and peaks.pressure_dips(np.full(50, np.inf), FS).tolist() == []
    x = np.where(np.abs(np.arange(600) - 300) < 60, -1.0, 0.0)
    x[10], x[20] = np.inf, -np.inf
    assert len(peaks.pressure_dips(x, FS)) == 1


def test_slope_onsets_by_hand():
    # derivative 0 1 3 1 -1 -4 -1 0: steepest at 2 (value 1) and 5 (value 4); 1 * 1 // 3 = 0, 4 * 1 // -4 = -1
    x = np.array([0, 0, 1, 4, 5, 4, 0, -1, -1.0])
    start, end, start_valid, end_valid = peaks.onoff_slope(x, 1.0, np.array([4]), 1)
    assert (start[0], end[0], start_valid[0], end_valid[0]) == (2, 6, True, True)
    # the quotient 5 / -2 goes down to -3, so the end moves three samples
    x = np.array([0, 0, 2, 6, 6.5, 5, 3, 2, 2, 2.0])
    assert peaks.onoff_slope(x, 1.0, np.array([4]), 1)[1][0] == 8
    # nothing steep on either side
    flat = peaks.onoff_slope(np.array([0, 1, 0.0]), 1.0, np.array([1]), 1)
    assert (flat[0][0], flat[1][0]) == (0, 2)
    assert [len(v) for v in peaks.onoff_slope(x, 1.0, np.empty(0, int), 1)] == [0, 0, 0, 0]


@pytest.mark.parametrize("steep", [True, False])
def test_slope_overlap_goes_to_the_steeper_side(steep):
    # the first peak falls by 1 a sample at most, the second rises by 5 or by .5 at most; their tangents cross
    rise = [10, 12, 17, 19] if steep else [9.6, 9.9, 10.4, 10.6]
    x = np.array([0, 1, 5, 9, 10, 9.8, 8.8, 8.6, 8.5, *rise, 19 if steep else 10.6, 18, 0, 0, 0.0])
    p = np.array([4, 12])
    start, end, start_valid, end_valid = peaks.onoff_slope(x, 1.0, p, 1)
    assert start[1] < end[0]
    if end[0] <= p[1]:
        assert (end_valid[0], start_valid[1]) == ((False, True) if steep else (True, False))
    else:
        assert not end_valid[0] and start_valid[1]


def test_slope_validity_against_a_loop():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = np.cumsum(rng.standard_normal(120)) + 8
        p, fs, w = peaks.find(x, prominence=1.0), 10.0, int(rng.integers(1, 4))
        start, end, start_valid, end_valid = peaks.onoff_slope(x, fs, p, w)
        d = np.diff(x) * fs
        inner = range(len(d))
        top = [k for k in inner if all(d[k] > d[max(k - s, 0)] and d[k] > d[min(k + s, len(d) - 1)] for s in range(1, w + 1))]
        low = [k for k in inner if all(d[k] < d[max(k - s, 0)] and d[k] < d[min(k + s, len(d) - 1)] for s in range(1, w + 1))]
        sides = []
        for k, at in enumerate(p):
            a, b = max((u for u in top if u < at), default=None), min((u for u in low if u > at), default=None)
            s = 0 if a is None else max(0, a - int(x[a] * fs // d[a]))
            e = len(x) - 1 if b is None else min(len(x) - 1, b - int(x[b] * fs // d[b]))
            late = k + 1 < len(p) and e > p[k + 1]
            sides.append([s, e, bool(s <= at), bool(e >= at and not late), 0.0 if a is None else d[a], 0.0 if b is None else d[b]])
            if k and s < sides[-2][1] and sides[-2][3]:
                if sides[-1][4] > -sides[-2][5]:
                    sides[-2][3] = False
                else:
                    sides[-1][2] = False
        assert [tuple(v[:4]) for v in sides] == list(zip(start.tolist(), end.tolist(), start_valid.tolist(), end_valid.tolist(), strict=True))


def test_volume_and_occluded():
    v = np.clip(np.sin(2 * np.pi * 0.25 * T), 0, None)
    assert len(peaks.volume_breaths(v, 10)) == 5
    p = 5 - 10 * np.clip(np.sin(2 * np.pi * 0.25 * T), 0, None)
    assert len(peaks.occluded_breaths(p, FS, 5.0)) == 5


def test_gating_fills():
    x = np.arange(20.0)
    assert ecg.gate(x, np.array([10]), 4, 0)[8:12].tolist() == [0, 0, 0, 0]
    assert np.allclose(ecg.gate(x, np.array([10]), 4, 1), x)
    assert ecg.gate(x, np.array([10]), 4, 2)[8] == pytest.approx(5.5)
    assert ecg.gate(np.ones(20), np.array([10]), 4, 3)[9] == pytest.approx(1)


def test_threshold_follows_the_midranges():
    x = np.array([0.0, 2, 4, 6, 8, 10])
    assert ecg.midrange(x, 3, 1).tolist() == [2, 2, 4, 6, 8, 8]  # 2 at place 1, 8 at place 4
    assert np.allclose(ecg.midrange(x, 3, 2), [2, 8 / 3, 4, 6, 22 / 3, 8])
    assert ecg.midrange(x[:4], 3, 1).tolist() == [2, 2, 4, 6]  # the last interval is the one sample 6, at place 3
    assert np.allclose(ecg.smooth(np.array([1.0, 2, 6]), 99), [4 / 3, 3, 14 / 3])  # an odd width within the signal


def test_runs_and_their_tops():
    x = np.array([3.0, 1, 2, 2, 0, 5, 4, 9])
    over = np.array([1, 0, 1, 1, 0, 1, 1, 1], bool)
    assert [a.tolist() for a in ecg.runs(over)] == [[0, 2, 5], [1, 4, 8]]
    assert ecg.run_tops(x, over).tolist() == [0, 2, 7]
    assert ecg.run_tops(x, np.zeros(8, bool)).tolist() == []


def test_beats_are_made_steady():
    strength = np.zeros(500)
    strength[[0, 100, 120, 200, 400]] = 5, 5, 4, 5, 5
    strength[[250, 300, 380]] = 2, 3, 9  # 380 lies beyond 366, where the next beat is expected at the latest
    peaks_, rejected, restored = ecg.steady_beats(np.array([0, 100, 120, 200, 400]), strength, np.full(500, 1.0), 0.66)
    assert peaks_.tolist() == [0, 100, 200, 300, 400] and rejected.tolist() == [120] and restored.tolist() == [300]
    strength[120] = 6  # of two beats too close, the stronger stays
    # the median interval is then 120, so the next beat may come until 399
    peaks_, rejected, restored = ecg.steady_beats(np.array([0, 100, 120, 200, 400]), strength, np.full(500, 4.5), 0.66)
    assert peaks_.tolist() == [0, 120, 200, 380, 400] and rejected.tolist() == [100] and restored.tolist() == [380]
    assert ecg.steady_beats(np.array([0, 100, 200, 400]), strength, np.full(500, 99.0), 0.66)[2].tolist() == []


#: A complex from five samples before R to five after, with Q two before and S two after.
COMPLEX = np.array([0, 0.1, 0, -1, 2, 9, 3, -2, -0.5, 0.2, 0])


def beats(n=3940, period=100, scale=lambda k: 1.0):
    """A beat in each interval of the threshold, which is then the same for all; the first and the last have no whole window."""
    x = np.zeros(n)
    for k, r in enumerate(range(20, n, period)):
        x[r - 5 : r + 6] += scale(k) * COMPLEX
    return x


def test_equal_beats_are_taken_away_whole():
    x = beats()
    found = ecg.estimated_subtraction(x, 200.0)
    r = np.arange(120, 3900, 100)
    assert found.qrs[:, 1].tolist() == r.tolist() and len(found.template) == 61
    (before,), (after,) = np.unique(found.qrs[:, 0] - r), np.unique(found.qrs[:, 2] - r)
    assert before in (-2, -1) and after in (1, 2)
    q, s = COMPLEX[5 + before], COMPLEX[5 + after]
    assert np.allclose(found.template[25:30], (COMPLEX[:5] - q) / (9 - q)) and np.allclose(found.template[30:36], (COMPLEX[5:] - s) / (9 - s))
    inside = slice(60, 3820)
    assert np.abs(found.cleaned[inside]).max() < 1e-9 and np.allclose(found.estimate[inside], x[inside], atol=1e-9)
    assert np.array_equal(found.cleaned[:60], x[:60])


def test_noise_stays_between_beats():
    rng = np.random.default_rng(4)
    noise = 0.01 * rng.standard_normal(3940)
    x = beats() + noise
    found = ecg.estimated_subtraction(x, 200.0)
    assert len(found.qrs) == 38 and np.std(found.cleaned[60:3820]) < 0.5 * np.std(x)
    away = np.ones(3940, bool)
    for k in found.qrs[:, 1]:
        away[k - 30 : k + 31] = False
    assert np.array_equal(found.cleaned[away], x[away])  # nothing is touched between the beats


def test_output_band_before_or_after():
    x = beats() + 0.1 * np.sin(np.arange(3940) / 3)
    plain = ecg.estimated_subtraction(x, 200.0)
    sections = iir.butterworth(4, (10.0, 40.0), 200.0, "bandpass")
    before = ecg.estimated_subtraction(x, 200.0, output_band=(10.0, 40.0), output_stage="before_subtraction")
    after = ecg.estimated_subtraction(x, 200.0, output_band=(10.0, 40.0))
    assert np.allclose(before.cleaned, iir.zero_phase(sections, x) - plain.estimate) and np.allclose(after.cleaned, iir.zero_phase(sections, plain.cleaned))


@pytest.mark.parametrize(
    ("x", "how", "says"),
    [
        (np.zeros(500), {}, "not all alike"),
        (np.r_[beats(), np.nan], {}, "finite"),
        (beats(), {"band": (4.0, 150.0)}, "half the sampling rate"),
        (beats(), {"tolerance": 1.0}, "tolerance"),
        (beats(), {"fewest": 40}, "are needed"),
        (beats(), {"longest": 0.4}, "isn't plausible"),
        (beats(), {"shortest": 0.9}, "isn't plausible"),
        (beats(), {"shortest": 3.0}, "below the longest"),
        (beats(), {"output_band": (1.0, 9.0), "output_stage": "now"}, "stage"),
    ],
)
def test_what_cannot_be_estimated(x, how, says):
    with pytest.raises(ValueError, match=says):
        ecg.estimated_subtraction(x, 200.0, **how)


def test_subtraction_in_spark_tells_why_not(spark):
    packed = spark.createDataFrame([(1, beats().tolist()), (2, [0.0] * 100)], "recording_id long, values array<double>")
    got = {r.recording_id: r for r in filters.subtract_ecg(packed, 200.0, strict=False).collect()}
    assert got[1].reason is None and max(map(abs, got[1]["values"][60:3820])) < 1e-9 and "alike" in got[2].reason and got[2]["values"] == [0.0] * 100
    with pytest.raises(Exception, match="alike"):
        filters.subtract_ecg(packed, 200.0).collect()
    rows = filters.ecg_complexes(packed.where("recording_id = 1"), 200.0).collect()
    assert [(r.r_idx, r.restored) for r in rows] == [(k, False) for k in range(120, 3900, 100)]


def test_wavelet_rebuilds():
    x = np.random.default_rng(0).standard_normal(300)
    assert np.allclose(ecg.wavelet_denoise(x, np.empty(0, int), 10), x)


def test_regions_and_watershed():
    m = np.zeros((4, 4), bool)
    m[0, :3] = m[2, 3] = True
    assert label_regions(m).max() == 2
    m[1, 3] = True
    assert label_regions(m).max() == 2 and label_regions(m, 2).max() == 1
    a = np.zeros((5, 5))
    a[1, 1] = a[3, 3] = 1
    assert len(np.unique(watershed(a))) >= 2


def test_student_t():
    assert student_t(0.975, 4) == pytest.approx(2.7764451052, abs=1e-8)
    assert student_t(0.975, 30) == pytest.approx(2.0422724563, abs=1e-8)
