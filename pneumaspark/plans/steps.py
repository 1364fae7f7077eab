"""The registered steps of the workflow language, as thin calls of the operators.

``samples`` are (recording_id, idx, t, value); parameters in seconds become samples
by ``fs`` of the step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark import export
from pneumaspark.operators import chunks, filters, linking, metrics, peaks, pixels, quality, slicing, windows
from pneumaspark.plans.workflow import step
from pneumaspark.sources import recordings
from pneumaspark.sources.bindings import pack, unpack


def filtered(samples: DataFrame, packed: DataFrame) -> DataFrame:
    """Samples with the values of a filtered array in their place."""
    return samples.drop("value").join(unpack(packed), ["recording_id", "idx"])


def n_samples(seconds: float, fs: float) -> int:
    return max(1, int(seconds * fs))


# ---- loading and slicing

for _name, _alias in (("eit.load", ()), ("eit.load_custom", ()), ("emg.load", ()), ("ventilator.load", ("emg.load_ventilator",))):

    @step(_name, *_alias)
    def load(spark, *, file_path, loader=None) -> DataFrame:
        """Read recording files by extension or with a given loader."""
        return recordings.load(spark, file_path, loader)


@step("ventilator.channels", "emg.ventilator_channels")
def ventilator_channels(samples: DataFrame, *, channels: dict) -> DataFrame:
    """Project the named channels: name -> label in the recording."""
    known = F.create_map(*[F.lit(x) for name, label in channels.items() for x in (label, name)])
    return samples.withColumn("channel", F.try_element_at(known, F.col("channel"))).where("channel IS NOT NULL")


@step("emg.select_channel")
def select_channel(samples: DataFrame, *, channel=None) -> DataFrame:
    return samples.where(F.col("channel") == (channel or recordings.choose_channel(samples)))


@step("eit.slice_signal", "eit.slice", choices={"mode": ("index", "time")})
def slice_signal(signal: DataFrame, *, start, end, mode="index") -> DataFrame:
    return slicing.slice_signal(signal, start, end, mode)


for _name, _alias in (("eit.slice_recording", ()), ("emg.slice_recording", ("emg.slice",)), ("ventilator.slice_recording", ())):

    @step(_name, *_alias)
    def slice_recording(samples: DataFrame, *, start_seconds, end_seconds=None) -> DataFrame:
        return slicing.keep_seconds(samples, start_seconds, end_seconds)


# ---- impedance frames


@step("eit.detect_rates", choices={"subject_type": ("adult", "neonate")})
def eit_detect_rates(signal: DataFrame, *, fs=20.0, subject_type="adult", welch_window_seconds=30.0) -> DataFrame:
    return filters.detect_rates(pack(signal), fs, subject_type, welch_window_seconds)


@step("eit.mdn_filter")
def mdn_filter(signal: DataFrame, *, respiratory_rate_hz, heart_rate_hz, fs=20.0) -> DataFrame:
    return filtered(signal, filters.multiple_digital_notch(pack(signal), respiratory_rate_hz, heart_rate_hz, fs))


@step("eit.butterworth_filter", choices={"mode": ("lowpass", "highpass", "bandpass", "bandstop")})
def eit_butterworth(signal: DataFrame, *, fs=20.0, mode="lowpass", lowpass_hz=1.0, highpass_hz=0.05, order=4) -> DataFrame:
    cutoff = {"lowpass": lowpass_hz, "highpass": highpass_hz}.get(mode, (highpass_hz, lowpass_hz))
    return chunks.butterworth(signal, mode, cutoff, fs, order)


@step("eit.global_impedance")
def global_impedance(frames: DataFrame) -> DataFrame:
    return pixels.global_impedance(frames)


for _name in ("eit.regional_impedance", "eit.functional_impedance"):

    @step(_name)
    def masked_impedance(frames: DataFrame, mask: DataFrame) -> DataFrame:
        weight = F.when(F.col("included"), 1.0) if "included" in mask.columns else F.col("weight")
        return pixels.masked_impedance(frames, mask.select("recording_id", "pixel", weight.alias("weight")))


@step("eit.detect_breaths")
def eit_detect_breaths(signal: DataFrame, *, fs=20.0, min_duration_s=2 / 3, average_seconds=15.0, amplitude_fraction=0.25) -> DataFrame:
    """Alternating extrema on either side of a moving average, without shallow peaks."""
    e = peaks.strict_extrema(windows.moving_average(signal, n_samples(average_seconds, fs), padding="none"))
    e = e.withColumn("is_peak", F.col("is_peak") & (F.col("value") > F.col("average"))).withColumn("is_valley", F.col("is_valley") & (F.col("value") < F.col("average")))
    breaths = peaks.valley_peak_valley(peaks.reduce_runs(e))
    depth = metrics.tidal_variation(signal, breaths, "mean")
    middle = depth.groupBy("recording_id").agg((amplitude_fraction * F.median("tidal_variation")).alias("least"))
    kept = breaths.join(depth, ["recording_id", "breath_no"]).join(middle, "recording_id").where("tidal_variation >= least")
    return kept.where(F.col("end_idx") - F.col("start_idx") >= min_duration_s * fs).select(*breaths.columns)


@step("eit.normalize_breaths")
def eit_normalize_breaths(breath_intervals: DataFrame, *, fs=20.0) -> DataFrame:
    names = {"start_idx": "start_time", "peak_idx": "extremum_time", "end_idx": "end_time"}
    return breath_intervals.withColumns({t: F.col(i) / F.lit(fs) for i, t in names.items()}).withColumn("modality", F.lit("eit"))


@step("eit.continuous_tiv", choices={"method": ("inspiratory", "expiratory", "mean")})
def continuous_tiv(signal: DataFrame, breath_intervals: DataFrame, *, method="inspiratory") -> DataFrame:
    return metrics.tidal_variation(signal, breath_intervals, method)


@step("eit.eeli")
def eeli(signal: DataFrame, breath_intervals: DataFrame) -> DataFrame:
    return metrics.end_expiratory_level(signal, breath_intervals)


@step("eit.pixel_tiv")
def pixel_tiv(frames: DataFrame, breath_intervals: DataFrame) -> DataFrame:
    return pixels.pixel_tiv(frames, breath_intervals)


@step("eit.pixel_breaths", choices={"phase_correction_mode": pixels.PHASES})
def pixel_breaths(frames: DataFrame, breath_intervals: DataFrame, *, phase_correction_mode="negative amplitude") -> DataFrame:
    return pixels.pixel_breaths(frames, breath_intervals, phase_correction_mode)


@step("eit.roi_tiv_lungspace")
def roi_tiv(pixel_tiv: DataFrame, *, threshold=0.15) -> DataFrame:
    return pixels.lungspace(pixel_tiv, "tiv", threshold)


@step("eit.roi_amplitude_lungspace")
def roi_amplitude(frames: DataFrame, breath_intervals: DataFrame, *, threshold=0.15) -> DataFrame:
    return pixels.lungspace(pixels.pixel_amplitude(frames, breath_intervals), "amplitude", threshold)


@step("eit.roi_watershed")
def roi_watershed(amplitude: DataFrame, tiv: DataFrame, *, threshold_fraction=0.15, n_cols=32) -> DataFrame:
    return pixels.watershed_lungspace(amplitude, tiv, threshold_fraction, n_cols)


@step("eit.roi_filter_by_size", choices={"connectivity": (1, 2)})
def roi_size(mask: DataFrame, *, min_region_size=10, connectivity=1, n_cols=32) -> DataFrame:
    return pixels.filter_regions(mask, min_region_size, connectivity, n_cols)


# ---- muscle activity


@step("emg.notch_filter")
def emg_notch(samples: DataFrame, *, base_frequency, fs=2048.0, max_frequency=None) -> DataFrame:
    return chunks.harmonic_notch(samples, base_frequency, fs, max_frequency or None)


@step("emg.bandpass_filter")
def emg_bandpass(samples: DataFrame, *, fs=2048.0, high_pass_hz=20.0, low_pass_hz=None) -> DataFrame:
    return chunks.butterworth(samples, "bandpass", (high_pass_hz, low_pass_hz or min(0.95 * fs / 2, 500.0)), fs, 3)


@step("emg.preprocess")
def emg_preprocess(samples: DataFrame, *, fs=2048.0, high_pass_hz=20.0, low_pass_hz=None, notch_base_frequency=None, notch_before_bandpass=False) -> DataFrame:
    chain = [lambda x: emg_bandpass(x, fs=fs, high_pass_hz=high_pass_hz, low_pass_hz=low_pass_hz)]
    if notch_base_frequency:
        chain.insert(0 if notch_before_bandpass else 1, lambda x: emg_notch(x, base_frequency=notch_base_frequency, fs=fs))
    for f in chain:
        samples = f(samples)
    return samples


@step("emg.envelope", choices={"method": ("rms", "arv", "median")})
def emg_envelope(samples: DataFrame, *, fs=2048.0, window_seconds=0.25, method="rms") -> DataFrame:
    """Samples with their envelope in the place of the value."""
    return windows.rolling_envelope(samples, n_samples(window_seconds, fs), method).drop("value").withColumnRenamed("envelope", "value")


@step("emg.ecg_detect_peaks")
def ecg_detect(samples: DataFrame, *, fs=2048.0, peak_fraction=0.4, bandpass_filter=True) -> DataFrame:
    from pneumaspark.operators.kernels import ecg

    return filters.map_indices(pack(samples), lambda x: ecg.ecg_peaks(x, fs, peak_fraction, band=bandpass_filter))


@step("emg.ecg_gating", choices={"fill_method": (0, 1, 2, 3)})
def ecg_gating(samples: DataFrame, *, fs=2048.0, gate_width_samples=205, fill_method=1) -> DataFrame:
    return filtered(samples, filters.gate_ecg(pack(samples), fs, gate_width_samples, fill_method))


@step("emg.ecg_wavelet_denoising")
def ecg_wavelet(samples: DataFrame, *, fs=2048.0, hard_thresholding=True, levels=4, fixed_threshold=4.5) -> DataFrame:
    return filtered(samples, filters.wavelet_denoise(pack(samples), fs, max(1, int(0.1 * fs)), levels, fixed_threshold, hard_thresholding))


@step("emg.moving_baseline")
def moving_baseline(samples: DataFrame, *, fs=2048.0, window_seconds=7.5, step_seconds=0.2, percentile=33.0) -> DataFrame:
    """Samples with a ``baseline`` column."""
    return windows.moving_baseline(samples, n_samples(window_seconds, fs), n_samples(step_seconds, fs), percentile)


@step("emg.slopesum_baseline")
def slopesum_baseline(samples: DataFrame, *, fs=2048.0, window_seconds=7.5, step_seconds=0.2, percentile=33.0, augmented_percentile=25.0, moving_average_seconds=0.5, percentile_window_seconds=1.0) -> DataFrame:
    sizes = [n_samples(s, fs) for s in (window_seconds, step_seconds, moving_average_seconds, percentile_window_seconds)]
    return windows.slopesum_baseline(samples, *sizes, percentile, augmented_percentile)


@step("emg.detect_breaths")
def emg_detect_breaths(samples: DataFrame, *, prominence_factor=0.5, min_width=None) -> DataFrame:
    return filters.detect_breaths(pack(samples), "emg", factor=prominence_factor, width=min_width)


@step("emg.detect_breaths_valleys")
def emg_valleys(samples: DataFrame) -> DataFrame:
    """Breaths from valley to valley, by windows alone."""
    return peaks.valley_peak_valley(peaks.strict_extrema(samples))


@step("emg.peak_indices")
def peak_indices(events: DataFrame, *, fs=2048.0) -> DataFrame:
    return events.select("recording_id", F.bround(F.col("extremum_time") * F.lit(fs)).cast("long").alias("idx"))


@step("emg.onoffpeak_baseline_crossing")
def onoff_crossing(samples: DataFrame, peak_indices: DataFrame) -> DataFrame:
    return peaks.onoff_from_crossings(peaks.baseline_crossings(samples), peak_indices, samples)


@step("emg.onoffpeak_slope_extrapolation")
def onoff_slope(samples: DataFrame, *, fs=2048.0, slope_window_seconds=0.5, prominence=0.0) -> DataFrame:
    return filters.onoff_slope(pack(samples), fs, n_samples(slope_window_seconds, fs), prominence)


@step("emg.interpeak_dist")
def interpeak(ecg_peak_indices: DataFrame, peak_indices: DataFrame, *, threshold=1.1) -> DataFrame:
    return quality.interpeak_distance(ecg_peak_indices, peak_indices, threshold)


@step("emg.time_to_peak")
def time_to_peak(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    return metrics.time_to_peak(samples, breaths)


@step("emg.pseudo_slope")
def pseudo_slope(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    return metrics.pseudo_slope(samples, breaths)


@step("emg.amplitude")
def amplitude(samples: DataFrame, breaths: DataFrame) -> DataFrame:
    return metrics.amplitude_at_peaks(samples, breaths, "baseline" if "baseline" in samples.columns else None)


@step("emg.time_product")
def time_product(samples: DataFrame, breaths: DataFrame, *, fs=2048.0) -> DataFrame:
    return metrics.time_product(samples, breaths, fs, "baseline" if "baseline" in samples.columns else None)


@step("emg.area_under_baseline")
def area_under_baseline(samples: DataFrame, breaths: DataFrame, *, fs=2048.0, window_seconds=5.0) -> DataFrame:
    return metrics.area_under_baseline(samples, breaths, fs, n_samples(window_seconds, fs))


for _name, _alias in (("emg.respiratory_rate", ()), ("ventilator.respiratory_rate", ("emg.ventilator_respiratory_rate",))):

    @step(_name, *_alias)
    def respiratory_rate(peak_indices: DataFrame, *, fs=2048.0) -> DataFrame:
        return metrics.respiratory_rate(peak_indices, fs)


@step("emg.snr_pseudo")
def snr_pseudo(samples: DataFrame, breaths: DataFrame, *, fs=2048.0, minimum_snr=None) -> DataFrame:
    out = metrics.snr_pseudo(samples, breaths, fs)
    return out if minimum_snr is None else quality.threshold_flag(out, "snr_pseudo", "snr", minimum_snr, ">=")


@step("emg.percentage_under_baseline")
def percentage_under_baseline(areas: DataFrame, time_products: DataFrame, *, aub_threshold=40.0) -> DataFrame:
    return quality.percentage_under_baseline(areas, time_products, aub_threshold)


@step("emg.detect_local_high_aub")
def local_high_aub(areas: DataFrame, *, threshold_percentile=75.0, threshold_factor=4.0) -> DataFrame:
    return quality.local_high_aub(areas, "area", threshold_percentile, threshold_factor)


@step("emg.detect_extreme_time_products")
def extreme_time_products(time_products: DataFrame, *, upper_percentile=95.0, upper_factor=10.0, lower_percentile=5.0, lower_factor=0.1) -> DataFrame:
    return quality.extreme_time_products(time_products, "time_product", upper_percentile, upper_factor, lower_percentile, lower_factor)


@step("emg.evaluate_bell_curve_error")
def bell_curve(samples: DataFrame, breaths: DataFrame, *, fs=2048.0, limit=40.0) -> DataFrame:
    return quality.bell_curve_error(samples, breaths, fs, limit)


@step("emg.evaluate_event_timing")
def event_timing(first: DataFrame, second: DataFrame, *, min_delta=-0.5, max_delta=2.0) -> DataFrame:
    return quality.event_timing(first, second, min_delta, max_delta)


@step("emg.evaluate_respiratory_rates")
def rates(counts: DataFrame, *, minimum_fraction=0.1) -> DataFrame:
    return quality.rate_agreement(counts, minimum_fraction)


@step("emg.remove_invalid_breaths")
def remove_invalid(breaths: DataFrame, flags: DataFrame, *, flag_names=("start_end_validity",)) -> DataFrame:
    return quality.remove_invalid_breaths(breaths, flags, list(flag_names))


# ---- ventilator


@step("ventilator.detect_breaths", "emg.detect_ventilator_breath")
def vent_breaths(samples: DataFrame, *, fs=100.0, breath_width_seconds=0.5) -> DataFrame:
    return filters.detect_breaths(pack(samples), "volume", width=n_samples(breath_width_seconds, fs))


@step("ventilator.detect_pressure_breaths")
def pressure_breaths(samples: DataFrame, *, fs=100.0, smoothing_seconds=0.2, min_depth=0.15, min_interval_seconds=2.0) -> DataFrame:
    return filters.detect_breaths(pack(samples), "dips", fs=fs, smooth=smoothing_seconds, depth=min_depth, interval=min_interval_seconds)


@step("ventilator.find_occluded_breaths", "emg.find_occluded_breaths")
def occluded(samples: DataFrame, *, peep, fs=100.0) -> DataFrame:
    return filters.detect_breaths(pack(samples), "occluded", fs=fs, peep=peep)


@step("ventilator.pocc_intervals", "emg.pocc_intervals")
def pocc_intervals(samples: DataFrame, pocc_indices: DataFrame, *, fs=100.0, baseline_window_seconds=7.5, baseline_step_seconds=0.2, baseline_percentile=33.0) -> DataFrame:
    based = windows.moving_baseline(samples, n_samples(baseline_window_seconds, fs), n_samples(baseline_step_seconds, fs), baseline_percentile)
    return peaks.onoff_from_crossings(peaks.baseline_crossings(based), pocc_indices, samples)


@step("ventilator.pocc_time_product", "emg.pocc_time_product")
def pocc_time_product(samples: DataFrame, breaths: DataFrame, *, fs=100.0) -> DataFrame:
    return metrics.time_product(samples, breaths, fs, "baseline" if "baseline" in samples.columns else None)


@step("ventilator.pocc_quality", "emg.pocc_quality")
def pocc_quality(samples: DataFrame, manoeuvres: DataFrame, *, dp_up_10_threshold=0.0, dp_up_90_threshold=2.0, dp_up_90_norm_threshold=0.8) -> DataFrame:
    return quality.pocc_quality(samples, manoeuvres, (dp_up_10_threshold, dp_up_90_threshold, dp_up_90_norm_threshold))


@step("ventilator.normalize_breaths", "emg.normalize_ventilator_breaths")
def vent_normalize(peak_indices: DataFrame, samples: DataFrame, *, fs=100.0, breath_width_seconds=0.5) -> DataFrame:
    return peaks.normalize_breaths(peak_indices, samples, fs, breath_width_seconds)


@step("ventilator.detect_non_consecutive_manoeuvres", "emg.detect_non_consecutive_manoeuvres")
def non_consecutive(breath_indices: DataFrame, pocc_indices: DataFrame) -> DataFrame:
    return quality.non_consecutive(breath_indices, pocc_indices)


# ---- clocks, metrics and exports


@step("sync.raw_modalities", "session.sync_raw", choices={"method": ("manual_offset",)})
def sync_raw(clock: DataFrame, *, method="manual_offset", offset_seconds=0.0) -> DataFrame:
    """Set start times in the clock table (recording_id, modality, start_time); a number is the muscle recording's."""
    offsets = offset_seconds if isinstance(offset_seconds, dict) else {"emg": offset_seconds}
    return linking.shift_by_modality(clock.withColumn("start_time", F.lit(0.0)), offsets, ("start_time",)).withColumn("sync_method", F.lit(method))


@step("sync.skip")
def sync_skip(clock: DataFrame) -> DataFrame:
    return clock.withColumn("sync_method", F.lit("none"))


@step("sync.estimate_offset", choices={"method": ("manual",)})
def estimate_offset(*, method="manual", manual_offset_seconds=0.0) -> float:
    return float(manual_offset_seconds)


@step("sync.apply_estimated_offset")
def apply_offset(clock: DataFrame, offset_seconds: float, *, target_modality="eit", source_modalities=("emg", "ventilator")) -> DataFrame:
    shift = dict.fromkeys(source_modalities, -offset_seconds) | {target_modality: 0.0}
    return linking.shift_by_modality(clock.withColumn("start_time", F.lit(0.0)), shift, ("start_time",)).withColumn("sync_method", F.lit("manual_offset"))


@step("metric.interval_cv")
def interval_cv(intervals: DataFrame) -> DataFrame:
    return metrics.interval_cv(intervals)


@step("export.scalar_file", sink=True)
def scalar_file(value, *, path, precision=8) -> str:
    return export.write_scalar(value, path, precision)


@step("export.json_file", sink=True)
def json_file(payload, *, path) -> str:
    return export.write_json(payload, path)


@step("export.session_summary", sink=True)
def session_summary(tables: dict, *, output_dir, form="parquet") -> str:
    return export.write_tables(tables, output_dir, form)


@step("export.rotarc_result", sink=True)
def study_result(value, *, path, precision=8) -> str:
    return export.write_scalar(value, path, precision)
