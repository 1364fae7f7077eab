"""A session of recordings: a fluent front over the operators, all lazy.

Tables are kept by name; every action is noted in ``provenance``.  Raw recordings
are samples or frames; events are breaths with times on their own clock.  Recordings
come together through the clock dimension (``operators.clocks``): files of one
session share its ``session_id``, rows of a table share their ``recording_id``.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pneumaspark import export
from pneumaspark.operators import chunks, clocks, filters, heartbeats, linking, metrics, peaks, pixels, quality, slicing
from pneumaspark.plans import steps
from pneumaspark.sources import recordings
from pneumaspark.sources.bindings import pack

MODALITIES = ("eit", "emg", "ventilator")


@dataclasses.dataclass
class RecordingSession:
    spark: SparkSession
    session_id: str = "session"
    raw: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    fs: dict[str, float] = dataclasses.field(default_factory=dict)
    processed: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    events: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    results: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    start_times: dict[str, float] = dataclasses.field(default_factory=dict)
    sync_methods: dict[str, str] = dataclasses.field(default_factory=dict)
    sources: dict[str, str] = dataclasses.field(default_factory=dict)
    session_keys: dict[str, Column] = dataclasses.field(default_factory=dict)
    provenance: list[dict] = dataclasses.field(default_factory=list)

    def _note(self, action: str, **parameters: Any) -> "RecordingSession":
        self.provenance.append({"action": action, "parameters": parameters, "at": time.time()})
        return self

    # loading and slicing

    def load(self, modality: str, source: str | DataFrame, fs: float, loader: Callable | None = None, session: str | Column | None = None, **how: Any) -> "RecordingSession":
        """Load a recording; loading anew forgets its synchronization.

        ``session``: what the recording belongs to, a name or an expression over its rows (such as a part of ``path``).
        Files belong to this session, rows of a table to the session that their recording_id names.
        """
        is_path = isinstance(source, str)
        self.raw[modality] = recordings.load(self.spark, source, loader, **how) if is_path else source
        self.sources.pop(modality, None)
        if is_path and loader is None:
            self.sources[modality] = source
        default = F.lit(self.session_id) if is_path else F.col("recording_id")
        self.session_keys[modality] = (F.lit(session) if isinstance(session, str) else default if session is None else session).cast("string")
        self.fs[modality] = fs
        self.start_times.pop(modality, None)
        self.sync_methods.pop(modality, None)
        return self._note("load", modality=modality)

    def load_eit(self, source: str | DataFrame, fs: float = 20.0, loader: Callable | None = None, session: str | Column | None = None, **how: Any) -> "RecordingSession":
        return self.load("eit", source, fs, loader, session, **how)

    def load_emg(self, source: str | DataFrame, fs: float = 2048.0, loader: Callable | None = None, session: str | Column | None = None, **how: Any) -> "RecordingSession":
        return self.load("emg", source, fs, loader, session, **how)

    def load_ventilator(self, source: str | DataFrame, fs: float = 100.0, name: str | None = None, loader: Callable | None = None, session: str | Column | None = None, **how: Any) -> "RecordingSession":
        return self.load(f"ventilator:{name}" if name else "ventilator", source, fs, loader, session, **how)

    def slice(self, modality: str, start: float, end: float | None = None) -> "RecordingSession":
        """Cut a recording in seconds; its start on the shared clock moves with it."""
        if modality == "eit" and "pixels" in self.raw[modality].columns:
            cut = slicing.keep_seconds(self.raw[modality].withColumn("idx", F.col("frame_idx")), start, end)
            self.raw[modality] = cut.withColumn("frame_idx", F.col("idx")).drop("idx", "shift")
        else:
            self.raw[modality] = slicing.keep_seconds(self.raw[modality], start, end).drop("shift")
        if modality in self.start_times:
            self.start_times[modality] += start
        return self._note("slice", modality=modality, start=start, end=end)

    def slice_eit(self, start: float, end: float | None = None) -> "RecordingSession":
        return self.slice("eit", start, end)

    def slice_emg(self, start: float, end: float | None = None) -> "RecordingSession":
        return self.slice("emg", start, end)

    def slice_ventilator(self, start: float, end: float | None = None, name: str | None = None) -> "RecordingSession":
        return self.slice(f"ventilator:{name}" if name else "ventilator", start, end)

    # preprocessing

    def _keep(self, kind: dict, name: str, variant: str | None, overwrite: bool, value: DataFrame) -> None:
        key = f"{name}:{variant}" if variant else name
        if key in kind and not overwrite:
            raise ValueError(f"{key!r} is there already; pass overwrite=True or a variant")
        kind[key] = value

    def preprocess_eit(self, variant: str | None = None, overwrite: bool = False, mode: str = "lowpass", lowpass_hz: float = 1.0, highpass_hz: float = 0.05, order: int = 4) -> "RecordingSession":
        """Global impedance, band-filtered unless mode is none."""
        signal = pixels.global_impedance(self.raw["eit"])
        if mode != "none":
            signal = steps.eit_butterworth(signal, fs=self.fs["eit"], mode=mode, lowpass_hz=lowpass_hz, highpass_hz=highpass_hz, order=order)
        self._keep(self.processed, "eit", variant, overwrite, signal)
        return self._note("preprocess_eit", variant=variant, mode=mode)

    def channel_labels(self, modality: str) -> list[str]:
        """The channels of a raw recording in order: of Poly5 files from their heads, else from the rows' labels."""
        source = self.sources.get(modality, "")
        if source.lower().endswith(".poly5"):
            found = recordings.poly5_channels(self.spark, source).groupBy("channel").agg(F.min("number").alias("number"))
            return [r.channel for r in found.orderBy("number", "channel").collect()]
        return [r.channel for r in self.raw[modality].select("channel").distinct().orderBy("channel").collect()]

    def one_channel(self, modality: str, channel: str | int | None = None) -> DataFrame:
        """A raw recording's rows of one channel: the one named or numbered, else the only one that isn't an ECG; ``*`` keeps all."""
        x = self.raw[modality]
        if "channel" not in x.columns or channel == "*":
            return x
        labels = self.channel_labels(modality)
        if isinstance(channel, int):
            if not 0 <= channel < len(labels):
                raise ValueError(f"channel {channel} isn't one of {len(labels)}")
            channel = labels[channel]
        elif channel is not None and channel not in labels:
            raise ValueError(f"channel {channel!r} isn't one of {labels}")
        return x.where(F.col("channel") == (recordings.only_channel(labels) if channel is None else channel))

    def preprocess_emg(self, variant: str | None = None, overwrite: bool = False, channel: str | int | None = None, envelope_seconds: float = 0.25, method: str = "rms", remove_ecg: str | None = "gating", bandpass: bool = True, **how: Any) -> "RecordingSession":
        """Band-pass, heart-beat removal (gating, template or none), then the envelope, of one channel."""
        fs, x = self.fs["emg"], self.one_channel("emg", channel)
        x = steps.emg_preprocess(x, fs=fs, **how) if bandpass else x
        if remove_ecg == "gating":
            x = steps.ecg_gating(x, fs=fs)
        elif remove_ecg == "template":
            x = x.drop("value").join(heartbeats.subtract(x, fs).drop("reason"), ["recording_id", "idx"])
        x = steps.emg_envelope(x, fs=fs, window_seconds=envelope_seconds, method=method)
        self._keep(self.processed, "emg", variant, overwrite, x)
        return self._note("preprocess_emg", variant=variant, channel=channel)

    def preprocess_ventilator(self, name: str | None = None, variant: str | None = None, overwrite: bool = False, lowpass_hz: float | None = None, order: int = 4, channel: str | int | None = "*") -> "RecordingSession":
        key = f"ventilator:{name}" if name else "ventilator"
        x, fs = self.one_channel(key, channel), self.fs[key]
        if lowpass_hz:
            x = chunks.butterworth(x, "lowpass", min(lowpass_hz, 0.95 * fs / 2), fs, order)
        self._keep(self.processed, key, variant, overwrite, x)
        return self._note("preprocess_ventilator", name=name, variant=variant)

    # breaths

    def _timed(self, breaths: DataFrame, modality: str) -> DataFrame:
        fs = self.fs[modality]
        return breaths.withColumns({t: F.col(i) / F.lit(fs) for i, t in (("start_idx", "start_time"), ("peak_idx", "extremum_time"), ("end_idx", "end_time"))})

    def detect_eit_breaths(self, variant: str | None = None, **how: Any) -> "RecordingSession":
        key = f"eit:{variant}" if variant else "eit"
        self.events["eit_breaths"] = self._timed(steps.eit_detect_breaths(self.processed[key], fs=self.fs["eit"], **how), "eit")
        return self._note("detect_eit_breaths", variant=variant)

    def detect_emg_breaths(self, variant: str | None = None, **how: Any) -> "RecordingSession":
        """Envelope peaks; start and end are the peak until they are measured."""
        key = f"emg:{variant}" if variant else "emg"
        found = filters.detect_breaths(pack(self.processed[key]), "emg", **how)
        self.events["emg_breaths"] = self._timed(found.selectExpr("recording_id", "idx AS start_idx", "idx AS peak_idx", "idx AS end_idx"), "emg")
        return self._note("detect_emg_breaths", variant=variant)

    def detect_ventilator_breaths(self, width_seconds: float = 0.5) -> "RecordingSession":
        fs, x = self.fs["ventilator"], self.processed.get("ventilator", self.raw["ventilator"])
        found = filters.detect_breaths(pack(x), "volume", width=max(1, int(width_seconds * fs)))
        self.events["ventilator_breaths"] = peaks.normalize_breaths(found, x, fs, width_seconds)
        return self._note("detect_ventilator_breaths", width_seconds=width_seconds)

    def emg_moving_baseline(self, window_seconds: float = 7.5, step_seconds: float = 0.2, percentile: float = 33.0, variant: str | None = None) -> DataFrame:
        return steps.moving_baseline(self.processed[f"emg:{variant}" if variant else "emg"], fs=self.fs["emg"], window_seconds=window_seconds, step_seconds=step_seconds, percentile=percentile)

    def emg_slopesum_baseline(self, variant: str | None = None, **how: Any) -> DataFrame:
        return steps.slopesum_baseline(self.processed[f"emg:{variant}" if variant else "emg"], fs=self.fs["emg"], **how)

    def postprocess_emg(self, selected: tuple[str, ...] | None = None, window_seconds: float = 7.5, step_seconds: float = 0.2) -> dict[str, DataFrame]:
        """Per-breath features and flags over valley-to-valley breaths; names that aren't selected are left out."""
        fs = self.fs["emg"]
        based = self.emg_moving_baseline(window_seconds, step_seconds)
        breaths = peaks.valley_peak_valley(peaks.strict_extrema(based))
        peak_rows = breaths.select("recording_id", F.col("peak_idx").alias("idx"))
        made: dict[str, Callable[[], DataFrame]] = {
            "breaths": lambda: breaths,
            "amplitude": lambda: metrics.amplitude_at_peaks(based, breaths, "baseline"),
            "time_to_peak": lambda: metrics.time_to_peak(based, breaths),
            "pseudo_slope": lambda: metrics.pseudo_slope(based, breaths),
            "time_product": lambda: metrics.time_product(based, breaths, fs, "baseline"),
            "area_under_baseline": lambda: metrics.area_under_baseline(based, breaths, fs, max(1, int(5 * fs))),
            "respiratory_rate": lambda: metrics.respiratory_rate(peak_rows, fs),
            "snr_pseudo": lambda: metrics.snr_pseudo(based, breaths, fs),
            "local_high_aub": lambda: quality.local_high_aub(metrics.area_under_baseline(based, breaths, fs, max(1, int(5 * fs)))),
            "extreme_time_products": lambda: quality.extreme_time_products(metrics.time_product(based, breaths, fs, "baseline")),
            "bell_curve_error": lambda: quality.bell_curve_error(based, breaths, fs),
        }
        out = {name: f() for name, f in made.items() if selected is None or name in selected}
        self.results |= out
        self._note("postprocess_emg", selected=sorted(out))
        return out

    # events and clocks

    def add_events(self, name: str, events: DataFrame) -> "RecordingSession":
        self.events[name] = events
        return self._note("add_events", name=name)

    def get_events(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self.events.get(name, default)

    def synchronize_raw_modalities(self, offset_seconds: float | Mapping[str, float] = 0.0, reference_modality: str | None = None) -> "RecordingSession":
        """Store each recording's start on the shared clock; a number is the muscle recording's.  Nothing is resampled."""
        offsets = dict(offset_seconds) if isinstance(offset_seconds, Mapping) else {"emg": float(offset_seconds)}
        reference = linking.reference_modality(list(self.raw), reference_modality)
        zero = offsets.get(reference, 0.0)
        for m in self.raw:
            self.start_times[m] = offsets.get(m, 0.0) - zero
            self.sync_methods[m] = "manual_offset"
        return self._note("synchronize_raw_modalities", offsets=offsets, reference=reference)

    def skip_synchronization(self) -> "RecordingSession":
        for m in self.raw:
            self.sync_methods[m] = "none"
        return self._note("skip_synchronization")

    align_modalities = synchronize_raw_modalities

    def _recordings(self, modality: str) -> DataFrame:
        """Rows that name a modality's recordings: heads or a listing of binary files, else the samples themselves."""
        source = self.sources.get(modality, "")
        about = {".poly5": recordings.poly5_channels, ".bin": recordings.frame_files}.get("." + source.rpartition(".")[2].lower())
        return about(self.spark, source) if about else self.raw[modality]

    def clocks(self) -> DataFrame:
        """The clock dimension: a row for each recording that was loaded, with its session and start."""
        rows = [clocks.clock_rows(self._recordings(m), m, self.session_keys.get(m, F.col("recording_id")), self.start_times.get(m, 0.0), self.sync_methods.get(m)) for m in self.raw]
        # breath lists without a recording are on the clock of their modality
        bare = {m: self.events[f"{m}_breaths"] for m in MODALITIES if f"{m}_breaths" in self.events and m not in self.raw}
        rows += [clocks.clock_rows(x, m, F.col("recording_id"), self.start_times.get(m, 0.0), self.sync_methods.get(m)) for m, x in bare.items()]
        return export.union_by_name(rows) if rows else self.spark.createDataFrame([], clocks.CLOCKS)

    def synchronize_multimodal_breaths(self) -> dict[str, DataFrame]:
        """Breath lists on the shared clock, with their sessions."""
        dimension = self.clocks()
        return {m: clocks.on_shared_clock(self.events[f"{m}_breaths"], dimension.where(F.col("modality") == m)) for m in MODALITIES if f"{m}_breaths" in self.events}

    def link_breaths(self, time_tolerance: float = 0.5) -> DataFrame:
        """Greedy links of each session's breaths by their extremum times, whatever files they come from."""
        lists = {m: self.events[f"{m}_breaths"] for m in MODALITIES if f"{m}_breaths" in self.events}
        self.results["linked_breaths"] = clocks.link_sessions(lists, self.clocks(), time_tolerance)
        self._note("link_breaths", time_tolerance=time_tolerance)
        return self.results["linked_breaths"]

    def compute_breath_timing_parameters(self, delay_pairs=None, duration_pairs=None, anchor: str = "start") -> DataFrame:
        """Delays, differences of durations and agreement of the linked breaths; replaces those computed before."""
        self.results["timing_parameters"] = clocks.breath_timing(self.results["linked_breaths"], delay_pairs, duration_pairs, anchor)
        self._note("compute_breath_timing_parameters", delay_pairs=delay_pairs, duration_pairs=duration_pairs, anchor=anchor)
        return self.results["timing_parameters"]

    # presets and exports

    def run_preset(self, name: str, **config: Any) -> "RecordingSession":
        """eit: filter and breaths; emg: envelope, breaths and features; multimodal: start times and links."""
        if name == "eit":
            self.preprocess_eit(overwrite=True, **config).detect_eit_breaths()
        elif name == "emg":
            self.preprocess_emg(overwrite=True, **config).detect_emg_breaths()
            self.postprocess_emg()
        elif name == "multimodal":
            self.synchronize_raw_modalities(config.get("offset_seconds", 0.0), config.get("reference_modality"))
            self.link_breaths(config.get("time_tolerance", 0.5))
        else:
            raise ValueError(f"unknown preset {name!r}; choose from eit, emg, multimodal")
        return self._note("run_preset", name=name)

    def export_summary(self, out: str, form: str = "parquet") -> str:
        """All events and results as tables, and the provenance as JSON."""
        export.write_tables({f"events_{k}": v for k, v in self.events.items()} | {f"result_{k}": v for k, v in self.results.items()}, out, form)
        export.write_json({"provenance": self.provenance, "start_times": self.start_times, "sync_methods": self.sync_methods}, f"{out}/summary.json")
        return out


