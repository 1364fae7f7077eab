"""Heart beats by chunk against the kernel on whole recordings."""

import numpy as np
import pytest

from pneumaspark.operators import heartbeats
from pneumaspark.operators.kernels import ecg
from pneumaspark.plans import catalog

COMPLEX = np.array([0, 0.1, 0, -1, 2, 9, 3, -2, -0.5, 0.2, 0])


def recording(n: int, seed: int, lost: float = 0.15, noise: float = 0.3) -> np.ndarray:
    """Beats at uneven intervals in noise; some are lost or weak, and others come too early."""
    r = np.random.default_rng(seed)
    x, at = noise * r.standard_normal(n), 40
    while at + 6 < n:
        if r.random() > lost:
            x[at - 5 : at + 6] += r.uniform(0.4, 1.5) * COMPLEX
        at += int(r.integers(40, 60) if r.random() < 0.1 else r.integers(90, 140))
    return x


def samples(spark, recordings, first=0):
    return spark.createDataFrame([(k, first + i, float(v)) for k, x in recordings.items() for i, v in enumerate(x)], "recording_id long, idx long, value double")


def restored_of(found: ecg.Subtraction) -> list[bool]:
    starts, ends = ecg.runs(found.detection > found.threshold)
    j = np.searchsorted(starts, found.restored, side="right") - 1
    return [bool(((r >= starts[j]) & (r < ends[j])).any()) for r in found.qrs[:, 1]]


@pytest.mark.parametrize(("first", "how"), [(777, {"tolerance": 0.3, "shortest": None}), (0, {"output_band": (10.0, 40.0)}), (0, {"output_band": (10.0, 40.0), "output_stage": "before_subtraction"})])
def test_chunks_give_what_whole_recordings_give(spark, first, how):
    whole = {1: recording(9000, 1), 2: recording(5000, 2, lost=0.4), 3: recording(800, 3, lost=0)}
    rows = samples(spark, whole, first)
    got = heartbeats.subtract(rows, 200.0, length=2048, **how).toPandas().sort_values(["recording_id", "idx"])
    beats = heartbeats.complexes(rows, 200.0, length=2048, **how).toPandas().sort_values(["recording_id", "r_idx"])
    again = 0
    for k, x in whole.items():
        found = ecg.estimated_subtraction(x, 200.0, **how)
        mine, own = got[got.recording_id == k], beats[beats.recording_id == k]
        assert mine.idx.tolist() == list(range(first, first + len(x))) and mine.reason.isna().all()
        assert np.allclose(mine.value, found.cleaned, atol=1e-9)
        assert (own[["q_idx", "r_idx", "s_idx"]].to_numpy() - first).tolist() == found.qrs.tolist()
        assert own.restored.tolist() == restored_of(found)
        again += len(found.restored)
    assert again > 0 or "tolerance" not in how


def test_a_run_over_many_chunks_is_one(spark):
    x = np.r_[recording(1500, 5), 40 * np.exp(-(((np.arange(400) - 200) / 60) ** 2)) * (1.5 + np.sin(np.arange(400) / 1.7)), recording(1500, 6)]
    how = {"smoothing": 1.0, "interval": 4.0, "shortest": None, "longest": None, "fewest": 1}
    found = ecg.estimated_subtraction(x, 200.0, **how)
    starts, ends = ecg.runs(found.detection > found.threshold)
    assert (ends - starts).max() > 3 * 64 and len(found.qrs)
    own = heartbeats.complexes(samples(spark, {1: x}), 200.0, length=64, **how).orderBy("r_idx").toPandas()
    assert own[["q_idx", "r_idx", "s_idx"]].to_numpy().tolist() == found.qrs.tolist()


def test_reasons(spark):
    poor = recording(3000, 8)
    poor[1500] = np.nan
    whole = {1: recording(3000, 7), 2: np.zeros(100), 3: poor, 4: np.r_[np.zeros(30), COMPLEX, np.zeros(30)], 5: np.array([1.0, 2.0])}
    rows = samples(spark, whole)
    got = heartbeats.subtract(rows, 200.0, strict=False, length=1024).toPandas().sort_values(["recording_id", "idx"])
    for k, x in whole.items():
        mine = got[got.recording_id == k]
        try:
            want, reason = ecg.estimated_subtraction(x, 200.0).cleaned, None
        except ValueError as e:
            want, reason = x, str(e)
        assert set(mine.reason.where(mine.reason.notna(), None)) == {reason}
        assert np.allclose(mine.value, want, equal_nan=True, atol=1e-9)
    with pytest.raises(ValueError, match="alike"):
        heartbeats.subtract(rows.where("recording_id = 2"), 200.0)
    with pytest.raises(ValueError, match="fewest|are needed"):
        heartbeats.complexes(rows.where("recording_id = 4"), 200.0)
    late = {"longest": 0.3}
    with pytest.raises(ValueError, match="isn't plausible"):
        heartbeats.complexes(rows.where("recording_id = 1"), 200.0, **late)
    with pytest.raises(ValueError, match="half the sampling rate"):
        heartbeats.complexes(rows, 200.0, band=(4.0, 150.0))


def test_queries_hold_no_recording_in_an_array(spark, monkeypatch):
    """The longest array that leaves the samples is a block's."""
    seen = []
    plain = heartbeats.blocks
    monkeypatch.setattr(heartbeats, "blocks", lambda rows: seen.append(plain(rows)) or seen[-1])
    sf = "/root/testdata/sf0.01"
    n = {r.recording_id: r.n for r in catalog.queries()["ecg_template_subtraction"](spark, sf).collect()}
    assert sum(r.n for r in catalog.queries()["ecg_complexes"](spark, sf).collect()) > 0
    assert len(seen) == 2
    for made in seen:
        assert made.selectExpr("max(size(x))").first()[0] <= heartbeats.BLOCK < min(n.values())
