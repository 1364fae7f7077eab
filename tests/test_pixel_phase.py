"""Pixels out of step with the whole: their lags, and their breaths by each correction."""

import numpy as np
import pytest

from pneumaspark.operators import peaks, pixels

SHIFTS = (0, 0, 0, 0, 0, 3, -2, 0)


def shifted(spark, n=400):
    t = np.arange(n)
    wave = lambda d: 1 - np.cos(2 * np.pi * (t - d) / 40 + 0.3)
    grid = np.stack([wave(d) for d in SHIFTS], axis=1)
    grid[:, 4] = 5.0  # never changes
    grid[:, 7] = -0.3 * wave(0)  # falls while the whole rises
    rows = [(1, k, [float(v) for v in grid[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "recording_id long, frame_idx long, pixels array<double>").repartition(6), grid


def test_lags_of_shifted_pixels(spark):
    frames, grid = shifted(spark)
    found = {r.pixel: (r.lag, r.correlation) for r in pixels.pixel_lags(frames, 8, length=90).collect()}
    assert 4 not in found and [found[k][0] for k in (0, 1, 2, 3)] == [0] * 4
    assert found[5][0] == 3 and found[6][0] == -2 and min(found[k][1] for k in (0, 5, 6)) > 0.99
    total = grid.sum(axis=1)
    for pixel, (lag, r) in found.items():
        a, b = (total[-lag:], grid[:lag, pixel]) if lag < 0 else (total[: len(total) - lag], grid[lag:, pixel])
        assert r == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    whole = {r.pixel: (r.lag, round(r.correlation, 9)) for r in pixels.pixel_lags(frames, 8).collect()}
    assert whole == {k: (d, round(r, 9)) for k, (d, r) in found.items()}


def test_breaths_by_each_correction(spark):
    frames, grid = shifted(spark)
    breaths = peaks.valley_peak_valley(peaks.strict_extrema(pixels.global_impedance(frames))).cache()
    got = {}
    for phase in pixels.PHASES:
        rows = pixels.pixel_breaths(frames, breaths, phase, most=8).where("breath_no = 3").collect()
        got[phase] = {r.pixel: (r.start_idx, r.middle_idx, r.end_idx) for r in rows}
    start, peak, end = breaths.where("breath_no = 3").select("start_idx", "peak_idx", "end_idx").first()
    top = lambda p: int(start - 10 + np.argmax(grid[start - 10 : end + 11, p]))
    assert got["phase shift"][5] == (start + 3, top(5), end + 3) and got["phase shift"][6] == (start - 2, top(6), end - 2)
    assert got["phase shift"][0][1] == top(0) and abs(got["none"][5][1] - top(5)) <= 1 and got["none"][5][2] == end  # the window cuts the shifted breath
    low = int(start + np.argmin(grid[start : end + 1, 7]))
    assert got["negative amplitude"][7][1] == low and got["none"][7][1] != low
    with pytest.raises(ValueError):
        pixels.pixel_breaths(frames, breaths, "other")
