"""Overlapping intervals against all pairs, and clock offsets that were planted."""

import numpy as np
import pytest

from pneumaspark.operators import clocks, rangejoin
from pneumaspark.operators.kernels import offset


def intervals(spark, rows):
    return spark.createDataFrame(rows, "recording_id long, k long, start_time double, end_time double")


def pairs(left, right, closed):
    touch = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    return {(r, i, j) for r, i, a, b in left for q, j, c, d in right if r == q and r is not None and None not in (a, b, c, d) and a <= b and c <= d and touch(a, d) and touch(c, b)}


@pytest.mark.parametrize("closed", [True, False])
def test_lengths_from_nothing_to_everything(spark, closed):
    rng = np.random.default_rng(11)

    def some(n):
        start = np.round(rng.uniform(-300, 300, n), 1)
        length = np.where(rng.random(n) < 0.1, 0, np.round(2.0 ** rng.uniform(-8, 10, n), 2))
        return [(int(r), k, float(a), float(a + w)) for k, (r, a, w) in enumerate(zip(rng.integers(0, 3, n), start, length, strict=True))]

    left, right = some(150), some(180)
    left += [(1, 900, -1e9, 1e9), (1, 901, 5.0, 4.0), (1, 902, None, 4.0), (None, 903, 0.0, 9.0), (2, 904, 8.0, 16.0), (2, 905, 16.0, 16.0)]
    right += [(1, 900, 1.0, None), (None, 903, 0.0, 9.0), (2, 904, 16.0, 32.0), (2, 905, 16.0, 16.0), (1, 906, 1e-9, 2e-9)]
    got = [(r.recording_id, r.left_k, r.right_k) for r in rangejoin.overlapping(intervals(spark, left), intervals(spark, right), closed=closed).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(left, right, closed) and len(got) > 500


def test_sides_may_be_empty_or_one_table(spark):
    rows = [(1, k, float(k), k + 1.5) for k in range(20)]
    one = intervals(spark, rows)
    got = rangejoin.overlapping(one, one).where("left_k < right_k").collect()
    assert {(r.left_k, r.right_k) for r in got} == {(k, k + 1) for k in range(19)}
    assert rangejoin.overlapping(one, one.limit(0)).count() == rangejoin.overlapping(one.limit(0), one).count() == 0
    assert rangejoin.overlapping(one, one).columns == ["recording_id", "left_k", "left_start_time", "left_end_time", "right_k", "right_start_time", "right_end_time"]


def pressure(seconds, fs, begins=0.0, seed=3):
    """Breaths of uneven lengths, sampled from ``begins`` on."""
    rng = np.random.default_rng(seed)
    knots, level = np.cumsum(rng.uniform(0.8, 2.5, 200)) - 40, rng.uniform(5, 25, 200)
    t = begins + np.arange(int(seconds * fs)) / fs
    return np.interp(t, knots, level)


def test_correlations_at_every_shift():
    rng = np.random.default_rng(0)
    for m, n in ((5, 9), (9, 5), (1, 3), (6, 6)):
        a, b = rng.standard_normal(m), rng.standard_normal(n)
        shifts, r, overlap = offset.shifted_correlations(a, b)
        assert shifts.tolist() == list(range(1 - m, n))
        for s, got, k in zip(shifts, r, overlap, strict=True):
            x, y = a[max(0, -s) : max(0, -s) + k], b[max(0, s) : max(0, s) + k]
            assert k == min(m - max(0, -s), n - max(0, s))
            if k > 2:
                assert got == pytest.approx(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("planted", [-12.345, 0.0, 0.004, 21.5])
def test_a_planted_offset_comes_back_to_a_fine_step(planted):
    reference, other = pressure(120, 100), 3 * pressure(120, 50, planted) - 7
    found, r = offset.clock_offset(reference, 100.0, np.r_[other, np.nan, np.nan], 50.0, (30.0, 60.0))
    assert found == pytest.approx(planted, abs=0.0021) and r > 0.999


def test_offsets_that_cannot_be_found():
    x = pressure(120, 100)
    with pytest.raises(ValueError, match="cover"):
        offset.clock_offset(x, 100.0, pressure(10, 100, 20.0), 100.0, (30.0, 60.0))
    with pytest.raises(ValueError, match="missing"):
        offset.clock_offset(np.r_[x[:50], np.nan, x[50:]], 100.0, x, 100.0, (30.0, 60.0))


def test_offsets_of_sessions(spark):
    rows, other = [], []
    for session, begins in (("a", 2.5), ("b", -4.25)):
        rows += [(session, k, float(v)) for k, v in enumerate(pressure(90, 40, seed=len(rows)))]
        other += [(session, k, float(v)) for k, v in enumerate(pressure(90, 40, begins, seed=len(rows) - 3600))]
    rows += [("c", k, 1.0) for k in range(100)]
    kind = "session_id string, idx long, value double"
    got = {r.session_id: r for r in clocks.estimate_offsets(spark.createDataFrame(rows, kind).repartition(5), spark.createDataFrame(other, kind), (20.0, 50.0), 40.0, 40.0).collect()}
    assert got["a"].offset == pytest.approx(2.5, abs=0.003) and got["b"].offset == pytest.approx(-4.25, abs=0.003) and got["a"].reason is None
    assert got["c"].offset is None and "isn't there" in got["c"].reason
