"""Binary recordings: ranges of a file in many tasks, pruning, writers and manifests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneumaspark.sources import binary_files, recordings, storage


def test_one_frame_file_gives_many_tasks(spark, tmp_path):
    pix = np.random.default_rng(2).random((500, 1024)).astype(np.float32)
    (tmp_path / "a.bin").write_bytes(binary_files.pack_frames(np.arange(500) / 20, pix, marker=np.arange(500)))
    size = binary_files.frame_size(52)
    got = recordings.read_frames(spark, f"file://{tmp_path}/a.bin", task_bytes=100 * size)
    assert got.rdd.getNumPartitions() == 5
    rows = got.select("frame_idx", "t", "marker", F.expr("pixels[3]").alias("p"), F.size("extra").alias("n")).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.marker, r.n) for r in rows] == [(k, k, 52) for k in range(500)]
    assert np.allclose([r.t for r in rows], np.arange(500) / 20) and np.allclose([r.p for r in rows], pix[:, 3])
    cut = recordings.read_frames(spark, f"file://{tmp_path}/a.bin", first=150, most=120, task_bytes=100 * size)
    assert cut.rdd.getNumPartitions() == 2 and sorted(r.frame_idx for r in cut.select("frame_idx").collect()) == list(range(150, 270))
    assert recordings.read_frames(spark, f"file://{tmp_path}/a.bin", first=900).count() == 0


def test_a_limited_read_touches_only_its_bytes(tmp_path):
    pix = np.zeros((50, 1024), np.float32)
    place = tmp_path / "a.bin"
    place.write_bytes(binary_files.pack_frames(np.arange(50) / 20, pix))
    reader = binary_files.FrameReader(str(place), 52, 10, 5, 1 << 20)
    parts = reader.partitions()
    assert [p.value[1:] for p in parts] == [(10, 15)]
    size = binary_files.frame_size(52)
    with place.open("r+b") as f:  # only these frames are good
        f.write(b"\xff" * 10 * size)
        f.seek(15 * size)
        f.write(b"\xff" * 35 * size)
    assert [round(t * 20) for b in reader.read(parts[0]) for t in b.column("t").to_pylist()] == [10, 11, 12, 13, 14]


def test_poly5_in_ranges_of_blocks(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((3, 5000)).astype(np.float32)
    x[1, 7] = np.nan
    (tmp_path / "a.poly5").write_bytes(binary_files.pack_poly5(x, 2048, ["left", "ecg", "right"], ["uV"] * 3))
    (tmp_path / "b.poly5").write_bytes(binary_files.pack_poly5(x[:1, :10], 100, ["left"], ["mV"]))
    (tmp_path / "_hidden").write_bytes(b"not a recording")
    step = binary_files.BLOCK_HEAD + 4 * 256 * 3
    for first, most, tasks in ((0, None, 7), (300, 700, 2), (4999, 9, 1)):
        got = recordings.read_poly5(spark, f"{tmp_path}/a.poly5", first, most, task_bytes=3 * step)
        assert got.rdd.getNumPartitions() == tasks
        end = 5000 if most is None else min(5000, first + most)
        rows = {(r.channel, r.idx): (r.t, r.value) for r in got.collect()}
        assert rows.keys() == {(c, k) for c in ("left", "ecg", "right") for k in range(first, end)}
        assert all(np.isclose(v, x[("left", "ecg", "right").index(c), k], equal_nan=True) and np.isclose(t, k / 2048) for (c, k), (t, v) in rows.items())
    assert recordings.read_poly5(spark, f"{tmp_path}/*.poly5", channels=["left"]).groupBy("path").count().count() == 2
    heads = {(r.path[-7:], r.channel): (r.number, r.unit, r.fs, r.n_samples) for r in recordings.poly5_channels(spark, str(tmp_path)).collect()}
    assert heads == {("a.poly5", "left"): (0, "uV", 2048, 5000), ("a.poly5", "ecg"): (1, "uV", 2048, 5000), ("a.poly5", "right"): (2, "uV", 2048, 5000), ("b.poly5", "left"): (0, "mV", 100, 10)}
    with pytest.raises(Exception, match="isn't a Poly5 file"):
        (tmp_path / "c.poly5").write_bytes(b"other")
        recordings.read_poly5(spark, f"{tmp_path}/c.poly5").count()


def test_writers_round_trip(spark, tmp_path):
    frames = spark.range(900).select((F.col("id") % 3).alias("recording_id"), F.expr("id div 3").alias("frame_idx"), (F.col("id") / 60).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: (k + F.col("id")).cast("double")).alias("pixels"), F.lit("mark").alias("text"))
    path = f"file://{tmp_path}/frames"
    recordings.write_frames(frames, path)
    (tmp_path / "frames" / "recording-0-leftover.bin").write_bytes(b"half")
    assert len(storage.listed(path)) == 3
    back = recordings.read_frames(spark, path)
    assert back.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("frame_idx").alias("k"), F.min("text").alias("x")).select("n", "k", "x").distinct().collect() == [(300, 300, "mark")]
    ids = F.regexp_extract("path", "recording-([0-9]+)-", 1).cast("long")
    wrong = back.where((F.col("pixels")[5] != ids + 3 * F.col("frame_idx") + 5) | (F.abs(F.col("t") - (ids + 3 * F.col("frame_idx")) / 60) > 1e-6))
    assert wrong.count() == 0
    with pytest.raises(Exception, match="1024"):
        recordings.write_frames(frames.withColumn("pixels", F.slice("pixels", 1, 9)), f"file://{tmp_path}/short")
    samples = spark.range(1000).selectExpr("id % 2 AS recording_id", "id div 2 AS idx", "explode(array('a', 'b')) AS channel", "CASE WHEN id <> 8 THEN id END AS value")
    recordings.write_poly5(samples, f"{tmp_path}/poly", 100, {"b": "mV", "a": "uV"})
    again = recordings.read_poly5(spark, f"{tmp_path}/poly", task_bytes=1)
    assert again.rdd.getNumPartitions() == 4
    got = {(int(r.path.split("recording-")[1][0]), r.channel, r.unit, r.idx): r.value for r in again.collect()}
    assert got.keys() == {(r, c, u, k) for r in range(2) for c, u in (("a", "uV"), ("b", "mV")) for k in range(500)}
    assert all(np.isnan(v) if (r, k) == (0, 4) else v == 2 * k + r for (r, _, _, k), v in got.items())
    recordings.write_poly5(samples, f"{tmp_path}/poly", 100, {"a": "uV"})  # a second write adds files
    assert len(storage.listed(f"{tmp_path}/poly")) == 4
