"""Channels by label, position and rank; filters that keep gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneumaspark.operators import channels, pixels
from pneumaspark.operators.kernels import gaps, iir

HEADS = "path string, number int, label string, unit string"


def resolved(spark, rows, requested=channels.USUAL, **how):
    got = channels.resolve_channels(spark.createDataFrame(rows, HEADS), requested, **how).collect()
    return {(r.path, r.key): (r.number, r.channel, r.origin, r.unit, r.is_primary) for r in got}


def test_labels(spark):
    cases = {"Airway_Pressure_(timpel)": "airway pressure", " PAW ": "paw", "Airway Pressure (Pod)": "airway pressure (pod)", "flow (raw) (Dräger)": "flow", "volume ( sentec )": "volume", "x (raw) (pod)": "x (raw) (pod)", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    got = {r.label: (r.p, r.q) for r in df.select("label", channels.plain_label(F.col("label")).alias("p"), channels.qualifier(F.col("label")).alias("q")).collect()}
    assert {k: p for k, (p, _) in got.items()} == cases
    assert got["Airway Pressure (Pod)"][1] == got["x (raw) (pod)"][1] == "pod" and got[" PAW "][1] is None
    df = spark.createDataFrame([("a (left  side)",)], "label string")
    assert df.select(channels.qualifier(F.col("label"))).first()[0] == "left_side"


def test_each_recording_by_its_labels(spark):
    rows = [("a", 0, "Flow", "L/s"), ("a", 1, "Airway Pressure", None), ("a", 2, "Airway pressure (pod)", "mbar"), ("a", 3, "Paw (Pod)", ""), ("a", 4, "airway pressure (POD)", " "), ("a", 5, "Volume", "mL")]
    rows += [("b", 0, "ch1", "V"), ("b", 1, "ch2", "V"), ("b", 2, None, "V"), ("b", 3, "ch4", "V")]  # no label is known: by position
    rows += [("c", 0, "Pes", "cmH2O"), ("c", 1, "other", None), ("c", 2, "flow", None)]  # one is, so nothing by position
    got = resolved(spark, rows)
    # "Paw (Pod)" isn't a known label: "paw" is, but a sensor's tag stays
    assert {k: v for k, v in got.items() if k[0] == "a"} == {
        ("a", "airway_pressure"): (1, "airway_pressure", None, "cmH2O", True), ("a", "airway_pressure__pod"): (2, "airway_pressure", "pod", "mbar", False),
        ("a", "airway_pressure__pod2"): (4, "airway_pressure", "pod", "cmH2O", False), ("a", "flow"): (0, "flow", None, "L/s", True), ("a", "volume"): (5, "volume", None, "mL", True),
    }
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "b"} == {"airway_pressure": 0, "flow": 1, "volume": 2}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "c"} == {"flow": 2}
    heads = spark.createDataFrame(rows, HEADS)
    missing = channels.unresolved(heads, channels.resolve_channels(heads)).collect()
    assert {tuple(r) for r in missing} == {("c", "airway_pressure"), ("c", "volume")}
    assert resolved(spark, rows[6:10], fallback=False) == {}


def test_positions_origins_and_new_names(spark):
    rows = [("a", 0, "paw", None), ("a", 1, "flow", None), ("a", 2, "pressure", None), ("a", 3, "CO2", None)]
    got = resolved(spark, rows, ("flow", "airway_pressure"), positions={"flow": 3}, origin="vent", qualify=True)
    assert got == {
        ("a", "flow__vent"): (3, "flow", "vent", "L/min", True), ("a", "airway_pressure__vent"): (0, "airway_pressure", "vent", "cmH2O", True),
        ("a", "airway_pressure__vent2"): (2, "airway_pressure", "vent", "cmH2O", False),
    }
    got = resolved(spark, rows, ("airway_pressure",))
    assert {k[1]: v[0] for k, v in got.items()} == {"airway_pressure": 0, "airway_pressure__col2": 2}
    assert resolved(spark, rows, ("flow",), positions={"flow": 9}) == {("a", "flow"): (9, "flow", None, "L/min", True)}  # a column that isn't there
    names = channels.ChannelNames()
    names.register("CO2", "capnogram", unit="%")
    names.register("Patm", "pressure")
    assert names.labels["patm"] == "airway_pressure"
    assert resolved(spark, rows, ("capnogram",), names=names) == {("a", "capnogram"): (3, "capnogram", None, "%", True)}
    for bad in ({"requested": ("capnogram",)}, {"positions": {"tidal_volume": 1}}):
        with pytest.raises(ValueError):
            resolved(spark, rows, **bad)


def test_split_and_primary(spark):
    heads = spark.createDataFrame([("a", 0, "Paw", None), ("a", 1, "Airway pressure (pod)", "mbar"), ("a", 2, "noise", None)], HEADS)
    specs = channels.resolve_channels(heads, ("airway_pressure",))
    samples = spark.createDataFrame([("a", c, k, float(k)) for c in ("Paw", "Airway pressure (pod)", "noise") for k in range(3)], "path string, channel string, idx long, value double")
    split = channels.split_channels(samples.withColumn("unit", F.lit("?")), specs)
    assert {(r.key, r.unit, r.n) for r in split.groupBy("key", "unit").agg(F.count("*").alias("n")).collect()} == {("airway_pressure", "cmH2O", 3), ("airway_pressure__pod", "mbar", 3)}
    assert [tuple(r) for r in channels.primary_channel(specs, "airway_pressure").collect()] == [("a", "airway_pressure")]
    assert channels.primary_channel(specs, "flow").count() == 0


def test_runs_are_filtered_and_gaps_put_back():
    sections = iir.butterworth(2, 1.0, 20.0, "lowpass")
    least = iir.edge(sections) + 1
    x = np.random.default_rng(0).standard_normal((120, 3)).cumsum(axis=0)
    x[:5, 0] = x[60:63, 0] = x[-1:, 0] = np.nan  # gaps at both ends and one inside
    x[:, 1] = np.nan
    x[least - 1 :: least, 2] = np.nan  # runs that are all one sample too short
    y = gaps.filter_runs(x, lambda v: iir.zero_phase(sections, v), least)
    assert np.allclose(y[5:60, 0], iir.zero_phase(sections, x[5:60, 0])) and np.allclose(y[63:-1, 0], iir.zero_phase(sections, x[63:-1, 0]))
    assert np.isnan(y[:5, 0]).all() and np.isnan(y[60:63, 0]).all() and np.isnan(y[-1, 0]) and np.isnan(y[:, 1:]).all()
    kept = gaps.filter_runs(x, lambda v: iir.zero_phase(sections, v), least, keep_short=True)
    assert np.array_equal(kept[:, 2], x[:, 2], equal_nan=True)
    flat = np.where(np.arange(120) % 50 == 20, np.nan, 3.0)[:, None]
    assert np.allclose(gaps.filter_runs(flat, lambda v: iir.zero_phase(sections, v), least)[~np.isnan(flat)], 3.0)  # a constant passes a low-pass


def test_frames_keep_their_gaps(spark):
    x = np.random.default_rng(1).standard_normal((400, 4)).cumsum(axis=0)
    x[:, 3] = np.nan
    rows = [(1, k, [None if np.isnan(v) else float(v) for v in x[k]], k / 20) for k in range(400)]
    frames = spark.createDataFrame(rows, "recording_id long, frame_idx long, pixels array<double>, t double").repartition(5)
    got = pixels.filter_preserving_gaps(frames, "lowpass", 2.0, 20.0, order=2, length=90)
    assert got.columns == frames.columns
    sections = iir.butterworth(2, 2.0, 20.0, "lowpass")
    y = {r.frame_idx: (r.pixels, r.t) for r in got.collect()}
    assert len(y) == 400 and all(p[3] is None and t == k / 20 for k, (p, t) in y.items())
    for c in range(3):
        assert np.allclose([y[k][0][c] for k in range(400)], iir.zero_phase(sections, x[:, c]), atol=1e-9)
    holed = frames.withColumn("pixels", F.when(F.col("frame_idx").between(100, 103), F.array(F.lit(None).cast("double"), *[F.col("pixels")[k] for k in (1, 2, 3)])).otherwise(F.col("pixels")))
    with pytest.raises(ValueError, match="part of a recording"):
        pixels.filter_preserving_gaps(holed, "lowpass", 2.0, 20.0)
    z = {r.frame_idx: r.pixels for r in pixels.filter_preserving_gaps(holed, "lowpass", 2.0, 20.0, order=2, strict=False, length=1000).collect()}
    assert [k for k in z if z[k][0] is None] and {k for k in z if z[k][0] is None} == {100, 101, 102, 103}
    assert np.allclose([z[k][0] for k in range(100)], iir.zero_phase(sections, x[:100, 0])) and np.allclose([z[k][0] for k in range(104, 400)], iir.zero_phase(sections, x[104:, 0]))
