"""The session front and the relational store, on synthetic recordings."""

import json

import numpy as np
import pytest

from pneumaspark.operators import clocks
from pneumaspark.recording_session import RecordingSession
from pneumaspark.sources import binary_files, synthetic
from pneumaspark.store import Store


def test_session(spark, tmp_path):
    x = synthetic.respiratory_signal(spark, 60, 20, noise=0.0).cache()
    frames = synthetic.to_frames(x, synthetic.lung_template(8, 8))
    s = RecordingSession(spark).load_eit(frames, 20).load_emg(x, 20).load_ventilator(x, 20)
    s.run_preset("eit", lowpass_hz=0.6)
    assert 8 <= s.get_events("eit_breaths").count() <= 16
    s.preprocess_emg(bandpass=False, remove_ecg=None)
    with pytest.raises(ValueError):
        s.preprocess_emg(bandpass=False, remove_ecg=None)
    s.detect_emg_breaths(width=10)
    s.detect_ventilator_breaths()
    out = s.postprocess_emg(("breaths", "amplitude", "respiratory_rate"))
    assert set(out) == {"breaths", "amplitude", "respiratory_rate"}
    s.run_preset("multimodal", offset_seconds={"emg": 0.1}, time_tolerance=1.0)
    assert s.start_times == {"eit": 0.0, "emg": 0.1, "ventilator": 0.0}
    assert s.results["linked_breaths"].where("confidence IS NOT NULL").count() >= 8
    assert s.compute_breath_timing_parameters().count() > 0
    s.export_summary(str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/summary.json").read_text())["sync_methods"]["emg"] == "manual_offset"
    s.load_emg(x, 20)
    assert "emg" not in s.start_times
    assert s.slice_emg(10, 20).raw["emg"].count() == 200
    with pytest.raises(ValueError):
        s.run_preset("other")


def test_store(spark, tmp_path):
    st = Store(spark)
    st.add("cases", spark.createDataFrame([("c", "one")], "case_id string, label string"))
    st.add("sessions", spark.createDataFrame([("s", "c", 0.0)], "session_id string, case_id string, start_time double"))
    st.record_signals(spark.createDataFrame([("emg", "EMG", "one", "uV", 100.0)], "modality string, category string, channel string, unit string, fs double"), "s")
    stream = st.streams_for_session("s").first()
    assert (stream.category, stream.unit) == ("emg", "µV") and st.sessions_for_case("c").count() == 1
    st.record_files(spark.createDataFrame([("/x/a.csv", "00")], "path string, checksum string"), "s")
    run = st.record_run("workflow", "w", inputs=[st["data_files"].first().file_id])
    assert st.record_run("workflow", "w") == run and st["processing_runs"].count() == 1
    st.record_parameters(spark.createDataFrame([("rate", 12.0, 0.0, 5.0)], "name string, value double, start_time double, end_time double"), run, [stream.signal_id])
    st.record_flags(spark.createDataFrame([("ok", True)], "name string, passed boolean"), "signal", stream.signal_id)
    st.record_synchronization(spark.createDataFrame([("emg", 1.5, "manual_offset")], "modality string, start_time double, sync_method string"))
    assert st["signal_streams"].first().time_offset_ms == 1500 and st.features_for_run(run).count() == 1
    assert st.annotations_for_target("signal", stream.signal_id).count() == 1 and st.files_for_signal("no").count() == 0
    assert st.validate().where("violations > 0").count() == 0
    st.export(str(tmp_path / "store"))
    st.add("breaths", spark.createDataFrame([("b", "none", stream.signal_id, 2.0, 1.0)], "breath_id string, session_id string, signal_id string, start_time double, end_time double"))
    broken = {r.rule for r in st.validate(True).where("violations > 0").collect()}
    assert {"breaths.session_id", "breaths ends before it starts", "signal_streams.start_time present"} <= broken
    with pytest.raises(ValueError):
        st.export(str(tmp_path / "again"))


def breathing(seconds, fs, rate=0.25, delay=0.0):
    t = np.arange(int(seconds * fs)) / fs
    return 1 - np.cos(2 * np.pi * rate * (t - delay))


def three_files(folder):
    """A frame file, a Poly5 file with an ECG lead and a text file of one breathing, each on a clock of its own."""
    eit = breathing(60, 20)
    pixels = np.repeat(eit[:, None], 1024, axis=1).astype(np.float32)
    (folder / "a.bin").write_bytes(binary_files.pack_frames(np.arange(len(eit)) / 20, pixels))
    rng = np.random.default_rng(0)
    effort = breathing(60, 200, delay=0.1) * rng.standard_normal(60 * 200)
    beats = np.zeros(60 * 200)
    beats[::160] = 40
    (folder / "a.poly5").write_bytes(binary_files.pack_poly5(np.stack([beats, effort]), 200, ["ECG lead", "EMGdi"], ["mV", "uV"]))
    volume = breathing(60, 100, delay=-1.75)
    rows = [f"{k / 100}\t{v}" for k, v in enumerate(volume)]
    (folder / "a.txt").write_text("\n".join(["header", "10 msec/sample", "1 channels", "Volume", "L", "sec\tCH1", f"\t{len(rows)}", *rows]))
    return {m: str(folder / f"a.{end}") for m, end in (("eit", "bin"), ("emg", "poly5"), ("ventilator", "txt"))}


def test_breaths_of_three_files_link(spark, tmp_path):
    files = three_files(tmp_path)
    s = RecordingSession(spark, "bed 4").load_eit(files["eit"], 20).load_emg(files["emg"], 200).load_ventilator(files["ventilator"], 100)
    assert s.channel_labels("emg") == ["ECG lead", "EMGdi"]
    s.preprocess_eit(mode="none").detect_eit_breaths()
    s.preprocess_emg(bandpass=False, remove_ecg=None, envelope_seconds=1.0).detect_emg_breaths(width=100)
    assert 13 <= s.get_events("emg_breaths").count() <= 17  # the ECG lead isn't taken for breathing
    s.detect_ventilator_breaths()
    s.synchronize_raw_modalities({"eit": 0.0, "emg": 0.0, "ventilator": 1.75}, reference_modality="eit")
    clocks = {r.modality: r for r in s.clocks().where("channel IS NULL OR channel <> 'ECG lead'").collect()}
    assert {r.session_id for r in clocks.values()} == {"bed 4"} and len({r.recording_id for r in clocks.values()}) == 3
    assert (clocks["ventilator"].start_time, clocks["ventilator"].sync_method, clocks["emg"].channel) == (1.75, "manual_offset", "EMGdi")
    links = s.link_breaths(0.6).cache()
    assert links.where("t_eit IS NOT NULL AND t_emg IS NOT NULL").count() >= 12
    assert links.where("t_eit IS NOT NULL AND t_ventilator IS NOT NULL").count() >= 13
    assert links.where("confidence IS NOT NULL").count() >= 14 and {r.session_id for r in links.select("session_id").distinct().collect()} == {"bed 4"}
    timing = {(r.name, r.method) for r in s.compute_breath_timing_parameters([("eit", "ventilator")], [], "extremum").select("name", "method").distinct().collect()}
    assert timing == {("eit_to_ventilator_delay", "timing_delay[extremum]"), ("eit_ventilator_event_agreement", "event_agreement")}
    with pytest.raises(ValueError):
        s.compute_breath_timing_parameters(anchor="middle")
    for channel in (7, "EMGxx"):
        with pytest.raises(ValueError):
            s.preprocess_emg(overwrite=True, channel=channel)


def test_timing_rows(spark):
    rows = [("a", 0, 1.0, 0.5, 2.0, 1.4, 0.8, 2.9, 0.9), ("a", 1, None, None, None, 5.0, 4.0, 6.5, None), ("b", 0, 3.0, 2.0, 4.0, None, None, None, None)]
    links = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[2], r[4], r[5], r[6], r[5], r[7], r[8]) for r in rows], "session_id string, link_no long, t_eit double, start_time_eit double, extremum_time_eit double, end_time_eit double, t_emg double, start_time_emg double, extremum_time_emg double, end_time_emg double, confidence double")
    got = {(r.session_id, r.link_no, r.name): (round(r.value, 6), r.unit, r.confidence) for r in clocks.breath_timing(links).collect()}
    assert got == {
        ("a", 0, "eit_to_emg_delay"): (0.3, "s", 0.9), ("a", 0, "eit_emg_duration_difference"): (-0.6, "s", 0.9),
        ("a", None, "eit_emg_event_agreement"): (0.5, None, None), ("b", None, "eit_emg_event_agreement"): (0.0, None, None),
    }
    assert {r.value for r in clocks.breath_timing(links, [("emg", "eit")], [], "end").where("link_no = 0").collect()} == {2.0 - 2.9}
    assert clocks.breath_timing(links, [], [("emg", "paw")]).count() == 0 and clocks.breath_timing(links, [], []).count() == 0


def test_places_on_clocks(spark):
    events = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, None), (3, 5.0, 6.0)], "recording_id long, start_time double, end_time double")
    dimension = clocks.moved(clocks.clock_rows(events.where("recording_id < 3"), "eit", "one"), {"eit": 0.5, "emg": 9.0})
    got = {(r.recording_id, r.session_id): (r.start_time, r.end_time) for r in clocks.on_shared_clock(events, dimension).collect()}
    assert got == {(1, "one"): (1.5, 2.5), (2, "one"): (1.5, None), (3, None): (5.0, 6.0)}
