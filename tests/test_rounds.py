"""Results that hold at any size: rounding, numbering and kernels that don't depend on how rows are dealt."""

import math

import numpy as np
from pyspark.sql import functions as F

from pneumaspark.operators import channels, filters, quality
from pneumaspark.operators.kernels import bell
from pneumaspark.plans import catalog
from pneumaspark.sources import bindings, recordings


def test_shares_between_two_decimals_dont_hang_on_the_last_bit(spark):
    middle = 36.40275
    shares = [(1, 0, math.nextafter(middle, 0), True), (1, 1, middle, True), (1, 2, math.nextafter(middle, 50), True)]
    rows = catalog.rounded_share(spark.createDataFrame(shares, "recording_id long, breath_no long, percentage double, passed boolean")).collect()
    assert {r.percentage for r in rows} == {36.4028}


def test_a_share_at_the_limit_passes_whatever_its_last_bit(spark):
    areas = spark.createDataFrame([(1, 0, 2.0), (1, 1, math.nextafter(2.0, 3)), (1, 2, 2.001)], "recording_id long, breath_no long, area double")
    products = spark.createDataFrame([(1, k, 3.0) for k in range(3)], "recording_id long, breath_no long, time_product double")
    found = {r.breath_no: r.passed for r in quality.percentage_under_baseline(areas, products).collect()}
    assert found == {0: True, 1: True, 2: False}


def test_many_bells_are_fitted_at_once_and_a_missing_sample_is_no_failure(spark, monkeypatch):
    monkeypatch.setattr(quality, "FITTED_AT_ONCE", 64)
    values = {r: [10 * math.exp(-((k - 15 - r) ** 2) / (2 * (3 + r) ** 2)) for k in range(40)] for r in range(5)}
    values[5] = [*values[0][:12], None, *values[0][13:]]
    samples = spark.createDataFrame([(r, k, v) for r, x in values.items() for k, v in enumerate(x)], "recording_id long, idx long, value double")
    breaths = spark.createDataFrame([(r, 0, 0, 15 + r, 39) for r in range(6)], "recording_id long, breath_no long, start_idx long, peak_idx long, end_idx long")
    found = {r.recording_id: (r.error, r.passed) for r in quality.bell_curve_error(samples, breaths, 10.0).collect()}
    assert found[5] == (None, False)
    assert all(found[r][0] < 10 and found[r][1] for r in range(5))


def test_bells_of_all_lengths_are_fitted_as_one_by_one():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 90, 40)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    x = np.concatenate([np.arange(n, dtype=float) for n in lengths])
    y = np.concatenate([np.exp(-((np.arange(n) - n / 2) ** 2) / n) + rng.normal(0, 0.02, n) for n in lengths])
    peak = lengths // 2
    one = [bell.errors(x[a : a + n], y[a : a + n], np.array([0]), np.array([p]), 1.0)[0] for a, n, p in zip(starts, lengths, peak, strict=True)]
    assert np.allclose(bell.errors(x, y, starts, peak, 1.0), one, rtol=1e-6)


def test_rows_are_numbered_by_runs_as_in_one_sort(spark):
    rng = np.random.default_rng(2)
    keys = [(int(g) if g < 3 else None, int(k) if k else None, n) for n, (g, k) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 60, 500), strict=True))]
    rows = spark.createDataFrame(keys, "g long, k long, n long")
    found = bindings.numbered(rows, "g", ("k", "n"), F.floor(F.col("k") / 7))
    assert found.columns == ["g", "k", "n", "idx"]
    want = {}
    for g in {r[0] for r in keys}:
        own = sorted((r for r in keys if r[0] == g), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        want |= {r[2]: i for i, r in enumerate(own)}
    assert {r.n: r.idx for r in found.collect()} == want


def test_poly5_samples_reach_the_writer_as_packed_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordings, "PACKED", 20)
    rows = [(r, c, k, None if k == 5 else float(k * 2 + r)) for r in (1, 2) for c in ("a", "b") for k in range(300 + r) if k != 7]
    recordings.write_poly5(spark.createDataFrame(rows, "recording_id long, channel string, idx long, value double"), str(tmp_path / "p"), 10.0, {"a": "mV", "b": "V"})
    found = recordings.read_poly5(spark, str(tmp_path / "p")).collect()
    for r in (1, 2):
        want = [(k, None if k == 5 else k * 2.0 + r) for k in range(300 + r) if k != 7]
        for c in ("a", "b"):
            own = sorted((x for x in found if f"recording-{r}-" in x.path and x.channel == c), key=lambda x: x.idx)
            assert [None if x.value is None or math.isnan(x.value) else x.value for x in own] == [v for _, v in want]


def test_packed_signals_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(filters, "HELD_VALUES", 10)
    rows = [(r, [float(k + r) for k in range(r % 7)]) for r in range(40)]
    packed = spark.createDataFrame([*rows, (40, [1.0, None])], "recording_id long, values array<double>").coalesce(1)
    found = {r.recording_id: r["values"] for r in filters.map_signals(packed, lambda x: 2 * x).collect()}
    assert found == {**{r: [2 * v for v in x] for r, x in rows}, 40: [2.0, None]}
    places = sorted((r.recording_id, r.idx) for r in filters.map_indices(packed, lambda x: np.arange(len(x))).collect())
    assert places == [(r, k) for r, x in [*rows, (40, [1, 1])] for k in range(len(x))]


def test_channels_are_resolved_without_joining_the_columns_with_themselves(spark):
    heads = spark.createDataFrame([("a", 0, "Paw", "mbar"), ("a", 1, "Paw", None), ("b", 0, "x", None), ("b", 1, "y", None)], "path string, number int, label string, unit string")
    found = channels.resolve_channels(heads)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the known names
    rows = {(r.path, r.key, r.label, r.unit, r.number) for r in found.collect()}
    assert rows == {("a", "airway_pressure", "Paw", "mbar", 0), ("a", "airway_pressure__col1", "Paw", "cmH2O", 1), ("b", "airway_pressure", "x", "cmH2O", 0), ("b", "flow", "y", "L/min", 1), ("b", "volume", None, "L", 2)}
