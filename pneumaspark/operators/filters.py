"""Whole-signal operators: a NumPy kernel for each recording, fed with Arrow batches.

Recordings are packed (recording_id, values).  A batch holds several recordings,
so there is no Python call per sample; nothing is grouped beyond the packing.  Kernels see
one recording at a time, as a view of its batch, and their results leave in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.operators.kernels import ecg, iir, peaks, spectrum

BY = "recording_id"


#: Values that a kernel gets and gives at once; a batch holds many recordings, and long ones a few at a time.
HELD_VALUES = 1 << 19


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(recording, its values) of a batch of packed recordings, as views of the batch where nothing is missing."""
    values = batch.column(1)
    flat, offsets = values.values, values.offsets.to_numpy()
    for k, r in enumerate(batch.column(0).to_pylist()):
        yield r, flat.slice(offsets[k], offsets[k + 1] - offsets[k]).to_numpy(zero_copy_only=False).astype(float)


def _packed(packed: DataFrame) -> DataFrame:
    return packed.select(F.col(BY).cast("long").alias(BY), F.col("values").cast("array<double>").alias("values"))


def map_signals(packed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str = "values") -> DataFrame:
    """(recording_id, name): the kernel of every recording's array."""

    def row_batch(ids: list[int], made: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made), from_pandas=True))], [BY, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, held = [], [], 0
            for r, x in _arrays(batch):
                ids.append(r)
                made.append(np.asarray(kernel(x), float))
                held += len(made[-1])
                if held >= HELD_VALUES:
                    yield row_batch(ids, made)
                    ids, made, held = [], [], 0
            if ids:
                yield row_batch(ids, made)

    return _packed(packed).mapInArrow(run, f"{BY} long, {name} array<double>")


def map_indices(packed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(recording_id, idx): one row per index that the kernel finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, held = [], [], 0
            for r, x in _arrays(batch):
                found = np.asarray(kernel(x), np.int64)
                ids.append(np.full(len(found), r, np.int64))
                places.append(found)
                held += len(found)
                if held >= HELD_VALUES:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], [BY, "idx"])
                    ids, places, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], [BY, "idx"])

    return _packed(packed).mapInArrow(run, f"{BY} long, idx long")


def map_numbers(packed: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """One row of numbers per recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, kernel(x)) for r, x in _arrays(batch)]
            if rows:
                made = [pa.array(np.array([float(row[n]) for _, row in rows]), from_pandas=True) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), *made], [BY, *names])

    return _packed(packed).mapInArrow(run, f"{BY} long, " + ", ".join(f"{n} double" for n in names))


def butterworth(packed: DataFrame, kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4) -> DataFrame:
    sections = iir.butterworth(order, cutoff, fs, kind)
    return map_signals(packed, lambda x: iir.zero_phase(sections, x))


def notch(packed: DataFrame, frequency: float, fs: float, quality: float = 30.0) -> DataFrame:
    sections = iir.notch(frequency, fs, quality)
    return map_signals(packed, lambda x: iir.zero_phase(sections, x))


def harmonic_notch(packed: DataFrame, base: float, fs: float, top: float | None = None, distance: float | None = None) -> DataFrame:
    return map_signals(packed, lambda x: iir.harmonic_notch(x, base, fs, top, distance))


def multiple_digital_notch(packed: DataFrame, respiratory: float, heart: float, fs: float) -> DataFrame:
    """Band-stops of +- 10/min at the heart rate's multiples below 220/min, then a low-pass at 220/min (our definition)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        k = 1
        while k * heart < min(220 / 60, fs / 2):
            low, high = max(k * heart - 10 / 60, (respiratory + heart) / 2 if k == 1 else 0), min(k * heart + 10 / 60, 0.99 * fs / 2)
            if low < high:
                x = iir.zero_phase(iir.butterworth(2, (low, high), fs, "bandstop"), x)
            k += 1
        return iir.zero_phase(iir.butterworth(4, min(220 / 60, 0.95 * fs / 2), fs, "lowpass"), x)

    return map_signals(packed, kernel)


def power_loss(packed: DataFrame, fs: float, kind: str, cutoff: float | tuple[float, float], order: int = 4) -> DataFrame:
    """(recording_id, loss): percent of power that a filter takes away."""
    sections = iir.butterworth(order, cutoff, fs, kind)
    return map_numbers(packed, lambda x: {"loss": spectrum.power_loss(x, iir.zero_phase(sections, x), fs, fs, 128, 25)}, ["loss"])


def detect_rates(packed: DataFrame, fs: float, subject: str = "adult", seconds: float = 30.0) -> DataFrame:
    """(recording_id, respiratory_hz, heart_hz)."""
    return map_numbers(packed, lambda x: dict(zip(("respiratory_hz", "heart_hz"), spectrum.detect_rates(x[:, None], fs, subject, seconds), strict=True)), ["respiratory_hz", "heart_hz"])


def detect_peaks(packed: DataFrame, **how) -> DataFrame:
    return map_indices(packed, lambda x: peaks.find(x, **how))


def detect_breaths(packed: DataFrame, detector: str, **how) -> DataFrame:
    """(recording_id, idx) by one of the detectors emg, volume, occluded, dips."""
    kernel = {"emg": peaks.emg_breaths, "volume": peaks.volume_breaths, "occluded": peaks.occluded_breaths, "dips": peaks.pressure_dips}[detector]
    return map_indices(packed, lambda x: kernel(x, **how))


def merge_close_peaks(packed: DataFrame, distance: float) -> DataFrame:
    return map_indices(packed, lambda x: peaks.merge_close(peaks.maxima(x), x, distance))


def onoff_slope(packed: DataFrame, fs: float, window: int, prominence: float) -> DataFrame:
    """(recording_id, peak_idx, start_idx, end_idx, start_valid, end_valid, valid)."""

    def run(batches):
        for pdf in batches:
            for r, v in zip(pdf[BY], pdf["values"], strict=True):
                x = np.asarray(v, float)
                p = peaks.find(x, prominence=prominence)
                start, end, start_valid, end_valid = peaks.onoff_slope(x, fs, p, window)
                yield pd.DataFrame({BY: r, "peak_idx": p, "start_idx": start, "end_idx": end, "start_valid": start_valid, "end_valid": end_valid, "valid": start_valid & end_valid})

    return packed.select(F.col(BY).cast("long").alias(BY), "values").mapInPandas(run, f"{BY} long, peak_idx long, start_idx long, end_idx long, start_valid boolean, end_valid boolean, valid boolean")


def gate_ecg(packed: DataFrame, fs: float, width: int = 205, fill: int = 1) -> DataFrame:
    return map_signals(packed, lambda x: ecg.gate(x, ecg.ecg_peaks(x, fs, band=False), width, fill))


def subtract_ecg(packed: DataFrame, fs: float, strict: bool = True, **how) -> DataFrame:
    """(recording_id, values, reason): each recording less its estimated ECG, see ``ecg.estimated_subtraction``.

    A recording in which it can't be estimated fails the job, or, unless ``strict``, comes
    back as it is with the reason.
    """

    def run(batches):
        for pdf in batches:
            out, reasons = [], []
            for v in pdf["values"]:
                x, reason = np.asarray(v, float), None
                try:
                    x = ecg.estimated_subtraction(x, fs, **how).cleaned
                except ValueError as e:
                    if strict:
                        raise
                    reason = str(e)
                out.append(x)
                reasons.append(reason)
            yield pd.DataFrame({BY: pdf[BY], "values": out, "reason": reasons})

    return packed.select(F.col(BY).cast("long").alias(BY), "values").mapInPandas(run, f"{BY} long, values array<double>, reason string")


def ecg_complexes(packed: DataFrame, fs: float, **how) -> DataFrame:
    """(recording_id, q_idx, r_idx, s_idx, restored): the complexes that make up each recording's template."""

    def run(batches):
        for pdf in batches:
            for r, v in zip(pdf[BY], pdf["values"], strict=True):
                found = ecg.estimated_subtraction(np.asarray(v, float), fs, **how)
                over = found.detection > found.threshold
                starts, ends = ecg.runs(over)
                again = np.zeros(len(found.qrs), bool)
                for k in found.restored:
                    j = np.searchsorted(starts, k, side="right") - 1
                    again |= (found.qrs[:, 1] >= starts[j]) & (found.qrs[:, 1] < ends[j])
                yield pd.DataFrame({BY: r, "q_idx": found.qrs[:, 0], "r_idx": found.qrs[:, 1], "s_idx": found.qrs[:, 2], "restored": again})

    return packed.select(F.col(BY).cast("long").alias(BY), "values").mapInPandas(run, f"{BY} long, q_idx long, r_idx long, s_idx long, restored boolean")


def wavelet_denoise(packed: DataFrame, fs: float, width: int, levels: int = 4, factor: float = 4.5, hard: bool = True) -> DataFrame:
    return map_signals(packed, lambda x: ecg.wavelet_denoise(x, ecg.ecg_peaks(x, fs, band=False), width, levels, factor, hard))
