"""Files joined to one recording, and shifted samples."""

from pneumaspark.sources.recordings import join_sequences
from pneumaspark.sources.synthetic import shift_samples


def test_join_sequences(spark):
    part = lambda rows: spark.createDataFrame(rows, "frame_idx long, t double")
    parts = [part([(0, 0.0), (1, 0.5)]), part([]), part([(7, 2.0), (5, 1.0)]), part([(0, 1.5)])]
    got = sorted((r.frame_idx, r.t, r.part, r.gap, r.in_order) for r in join_sequences(parts).collect())
    assert got == [(0, 0.0, 0, None, None), (1, 0.5, 0, None, None), (2, 1.0, 2, 0.5, True), (3, 2.0, 2, None, None), (4, 1.5, 3, -0.5, False)]


def test_shift_keeps_nulls(spark):
    rows = [("a", k, v) for k, v in enumerate([1.0, None, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "recording_id string, idx long, value double")
    assert [(r.idx, r.value) for r in shift_samples(df, 1).orderBy("idx").collect()] == [(1, 1.0), (2, None), (3, 3.0)]
    assert [(r.idx, r.value) for r in shift_samples(df, -2).orderBy("idx").collect()] == [(0, 3.0), (1, 4.0)]
