"""Chunks with a halo: the same values as on whole recordings, in many tasks; rolling kernels against plain windows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pneumaspark.operators import chunks, filters, windows
from pneumaspark.operators.kernels import iir, rolling
from pneumaspark.sources.bindings import pack, unpack

NUMBERS = st.lists(st.one_of(st.sampled_from([0.0, 1.0, 1.0, float("nan")]), st.floats(-9, 9)), min_size=1, max_size=60)


def window(x, i, before, after):
    w = np.asarray(x[max(0, i - before) : i + after + 1], float)
    return w[~np.isnan(w)]


@settings(max_examples=150, deadline=None)
@given(NUMBERS, st.integers(0, 9), st.integers(0, 9), st.sampled_from([0, 25, 33, 50, 100]))
def test_rolling_kernels(x, before, after, percentile):
    whole = [window(x, i, before, after) for i in range(len(x))]
    want = [np.percentile(w, percentile) if len(w) else np.nan for w in whole]
    assert np.allclose(rolling.running_percentile(x, before, after, percentile), want, equal_nan=True)
    at = np.arange(0, len(x), 3)
    assert np.allclose(rolling.percentile_at(x, at, before, after, percentile), np.array(want)[at], equal_nan=True)
    assert np.allclose(rolling.sums(x, before, after), [w.sum() for w in whole])
    for kernel, f in ((rolling.means, np.mean), (rolling.deviations, np.std), (rolling.rms, lambda w: np.sqrt(np.mean(w**2))), (rolling.arv, lambda w: np.mean(np.abs(w)))):
        assert np.allclose(kernel(x, before, after), [f(w) if len(w) else np.nan for w in whole], equal_nan=True)


def recording(spark, n=6000, ids=(1, 2)):
    rng = np.random.default_rng(7)
    rows = [(r, k, float(v), f"x{k % 3}") for r in ids for k, v in enumerate(rng.standard_normal(n // r).cumsum())]
    return spark.createDataFrame(rows, "recording_id long, idx long, value double, label string").repartition(8)


def values(df, *columns):
    return {(r.recording_id, r.idx): tuple(r[c] for c in columns) for r in df.collect()}


def test_filters_by_chunk_equal_whole_recordings(spark):
    samples = recording(spark).cache()
    for kind, cut, fs in (("bandpass", (80.0, 500.0), 2048.0), ("lowpass", 1.0, 20.0), ("highpass", 0.5, 20.0)):
        sections = iir.butterworth(4, cut, fs, kind)
        whole = values(unpack(filters.butterworth(pack(samples), kind, cut, fs), "values", "value"), "value")
        got = chunks.butterworth(samples, kind, cut, fs, length=700)
        assert got.columns == ["recording_id", "idx", "label", "value"] and got.where("label <> concat('x', idx % 3)").count() == 0
        found = values(got, "value")
        assert found.keys() == whole.keys() and max(abs(found[k][0] - whole[k][0]) for k in whole) < 1e-9
        assert chunks.settled(sections) < 2000


def test_a_chunk_never_holds_more_than_its_length_and_halo(spark):
    samples = recording(spark, 5000, (1,))
    sizes = chunks.spread(samples, 500, 40).groupBy("_chunk").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).where("own > 0").collect()
    assert len(sizes) == 10 and {r.own for r in sizes} == {500} and max(r.n for r in sizes) == 580
    assert chunks.spread(samples, 500).count() == 5000
    with pytest.raises(ValueError):
        chunks.spread(samples, 0)


def test_window_operators_in_chunks(spark):
    samples = recording(spark).cache()
    for operator, halo, column in (
        (lambda s: windows.rolling_envelope(s, 31, "rms"), 16, "envelope"),
        (lambda s: windows.rolling_envelope(s, 31, "median"), 16, "envelope"),
        (lambda s: windows.moving_average(s, 9), 5, "average"),
        (lambda s: windows.local_extrema_flags(s), 1, "flag"),
    ):
        whole, found = values(operator(samples), column), values(chunks.in_chunks(samples, operator, 640, halo), column)
        assert whole.keys() == found.keys() and all(whole[k][0] == pytest.approx(found[k][0], abs=1e-12) for k in whole)


def test_wide_envelopes_equal_windows(spark):
    samples = recording(spark, 3000).withColumn("value", F.when(F.col("idx") % 211 > 1, F.col("value"))).cache()
    for method in ("rms", "arv", "median"):
        for center, least in ((True, 1), (False, 90)):
            windows.WIDE = 10**9
            try:
                want = values(windows.rolling_envelope(samples, 101, method, center, least), "envelope")
            finally:
                windows.WIDE = 64
            got = values(windows.rolling_envelope(samples, 101, method, center, least), "envelope")
            assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_a_chain_of_notches_by_chunk(spark):
    samples = recording(spark, 4000, (1,))
    whole = values(unpack(filters.harmonic_notch(pack(samples), 5.0, 40.0), "values", "value"), "value")
    found = values(chunks.harmonic_notch(samples, 5.0, 40.0, length=1500), "value")
    assert found.keys() == whole.keys() and max(abs(found[k][0] - whole[k][0]) for k in whole) < 1e-8


def test_baselines_by_chunk(spark):
    samples = recording(spark).withColumn("value", F.when(F.col("idx") % 97 != 5, F.col("value"))).cache()
    for operator, columns in (
        (lambda n: windows.moving_baseline(samples, 301, 50, 33.0, length=n), ("baseline",)),
        (lambda n: windows.slopesum_baseline(samples, 301, 50, 11, 41, length=n), ("baseline", "slope_sum", "running_mean", "running_std")),
    ):
        whole, found = values(operator(1 << 18), *columns), values(operator(420), *columns)
        assert whole.keys() == found.keys() and len(whole) == 9000
        assert all(a == pytest.approx(b, abs=1e-9) for k in whole for a, b in zip(whole[k], found[k]))
    x = {(r.recording_id, r.idx): np.nan if r.value is None else r.value for r in samples.collect()}
    one = np.array([x[1, k] for k in range(6000)])
    found = values(windows.moving_baseline(samples, 301, 50, 33.0, length=420), "baseline")
    assert all(found[1, k][0] == pytest.approx(np.percentile(window(one, k - k % 50, 150, 150), 33.0)) for k in range(0, 6000, 7))


def test_a_minute_at_2048_hz_takes_seconds(spark):
    import time

    samples = spark.range(60 * 2048).selectExpr("1L AS recording_id", "id AS idx", "sin(id / 700) + rand(3) AS value")
    began = time.perf_counter()
    assert windows.moving_baseline(samples, int(7.5 * 2048), int(0.2 * 2048)).count() == 60 * 2048
    assert time.perf_counter() - began < 15
