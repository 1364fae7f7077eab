"""Readers and writers of recording files: tab text, binary frames and Poly5.

Text files are read with Spark's own reader.  Binary files are data sources of their
own (``binary_files``): a file is cut into ranges of frames or blocks, each a task's.
``recording_id`` is a hash of path and channel: operators go by it, so channels of a
file never mix.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pneumaspark.sources import binary_files, storage

BY = "recording_id"
#: Values of a run that is packed to a row: 8 KB, so that a batch of rows stays small.
PACKED = 1 << 11
SAMPLES = "path string, channel string, unit string, fs double, idx long, t double, value double"


def _identified(rows: DataFrame, *parts: str) -> DataFrame:
    return rows.select(F.xxhash64(*parts).alias(BY), "*")


# ---- tab-separated text with a header of label and unit lines


def read_tab_text(spark: SparkSession, path: str) -> DataFrame:
    """Samples (recording_id, path, channel, unit, fs, idx, t, value) of tab text files.

    Line 2 gives ``<ms> msec/sample``, line 3 ``<n> channels``; then a label and a
    unit line for each channel, a column header, a line to skip and the rows.  A
    leading time column is left out unless its header begins with CH.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def parse(batches):
        for pdf in batches:
            for name, text in zip(pdf["path"], pdf["value"], strict=True):
                lines = text.splitlines()
                fs, n = 1000 / float(lines[1].split()[0]), int(lines[2].split()[0])
                labels, units = lines[3 : 3 + 2 * n : 2], lines[4 : 4 + 2 * n : 2]
                header = lines[3 + 2 * n].split("\t")
                rows = np.array([[float(x) for x in r.rstrip("\t").split("\t")] for r in lines[5 + 2 * n :] if r.strip()])
                rows = rows.reshape(len(rows), -1)
                if not header[0].strip().upper().startswith("CH") and rows.shape[1] > n:
                    rows = rows[:, 1:]
                idx = np.arange(len(rows))
                for k in range(n):
                    yield pd.DataFrame({"path": name, "channel": labels[k].strip(), "unit": units[k].strip(), "fs": fs, "idx": idx, "t": idx / fs, "value": rows[:, k]})

    return _identified(files.mapInPandas(parse, SAMPLES), "path", "channel")


# ---- binary frames and Poly5: see ``binary_files``


def read_frames(spark: SparkSession, path: str, n_extra: int = 52, first: int = 0, most: int | None = None, task_bytes: int = binary_files.TASK_BYTES) -> DataFrame:
    """(recording_id, path, frame_idx, t, min_max, marker, text, pixels, extra) of binary frame files.

    A file is read by many tasks, each a range of frames; ``first`` and ``most`` cut every
    file by frame, and frames outside aren't touched.
    """
    spark.dataSource.register(binary_files.FrameFiles)
    source = spark.read.format("recording_frames").option("n_extra", n_extra).option("first", first).option("task_bytes", task_bytes)
    return _identified((source if most is None else source.option("most", most)).load(path), "path")


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, bytes) of frame files, from the listing alone."""
    return _identified(spark.createDataFrame(storage.listed(path), "path string, bytes long"), "path")


def embedded_channels(frames: DataFrame, channels: dict[str, int]) -> DataFrame:
    """Samples (recording_id, path, channel, idx, t, value) of channels that a frame file carries beside its pixels."""
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), F.get("extra", F.lit(k)).alias("value")) for n, k in channels.items()])
    return _identified(frames.select("path", F.explode(pairs).alias("c"), F.col("frame_idx").alias("idx"), "t").select("path", "c.channel", "idx", "t", "c.value"), "path", "channel")


def read_poly5(spark: SparkSession, path: str, first: int = 0, most: int | None = None, channels: list[str] | None = None, task_bytes: int = binary_files.TASK_BYTES) -> DataFrame:
    """Samples (recording_id, path, channel, unit, fs, idx, t, value) of Poly5 files.

    A file is read by many tasks, each a range of blocks; ``first`` and ``most`` cut every file
    by sample, and blocks outside aren't touched.  ``channels``: rows of these labels alone.
    """
    spark.dataSource.register(binary_files.Poly5Files)
    source = spark.read.format("poly5").option("first", first).option("task_bytes", task_bytes)
    source = source if most is None else source.option("most", most)
    return _identified((source if channels is None else source.option("channels", json.dumps(channels))).load(path), "path", "channel")


def poly5_channels(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, channel, number, unit, fs, n_samples) of Poly5 files, from their heads alone."""
    spark.dataSource.register(binary_files.Poly5Heads)
    return _identified(spark.read.format("poly5_heads").load(path), "path", "channel")


def write_frames(frames: DataFrame, path: str, n_extra: int = 52) -> None:
    """One binary frame file for each recording_id of (recording_id, frame_idx, t, pixels, and min_max, marker, text, extra where there are any).

    A recording is written by one task, frame by frame; pixels have to be 1024.
    """
    frames.sparkSession.dataSource.register(binary_files.FrameFiles)
    optional = {"min_max": F.lit(0), "marker": F.lit(0), "text": F.lit(""), "extra": F.array_repeat(F.lit(0.0), n_extra)}
    own = frames.select(F.col(BY).cast("long").alias(BY), "t", F.col("pixels").cast("array<double>").alias("pixels"), *[F.coalesce(F.col(c), d).alias(c) if c in frames.columns else d.alias(c) for c, d in optional.items()], "frame_idx")
    own.repartition(BY).sortWithinPartitions(BY, "frame_idx").drop("frame_idx").write.format("recording_frames").option("n_extra", n_extra).mode("append").save(path)


def write_poly5(samples: DataFrame, path: str, fs: float, channels: dict[str, str]) -> None:
    """One Poly5 file for each recording_id of (recording_id, channel, idx, value); ``channels``: unit by label, in the file's order.

    A recording is written by one task, block by block; a value that isn't there is a NaN.  Samples come to
    it in runs, packed as floats by many tasks, so that it sorts a row for thousands of samples.
    """
    samples.sparkSession.dataSource.register(binary_files.Poly5Files)
    values = F.array(*[F.max(F.when(F.col("channel") == c, F.col("value").cast("double"))) for c in channels])
    rows = samples.where(F.col("channel").isin(*channels)).groupBy(F.col(BY).cast("long").alias(BY), F.col("idx").cast("long").alias("idx")).agg(values.alias("values"))
    # idx may have gaps, so runs are of places, not of samples
    cut = F.floor(F.col("idx") / F.lit(max(1, PACKED // len(channels)))).cast("long")
    sizes = rows.groupBy(BY).agg(F.count(F.lit(1)).alias("n"))
    placed = rows.withColumn("run", cut).repartition(BY, "run").sortWithinPartitions(BY, "run", "idx").select(BY, "run", "values")
    packed = placed.mapInArrow(binary_files.packed_runs(len(channels)), f"{BY} long, run long, data binary")
    placed = packed.join(sizes, BY).repartition(BY).sortWithinPartitions(BY, "run").select(BY, "n", "data")
    placed.write.format("poly5").option("fs", fs).option("channels", json.dumps(channels)).mode("append").save(path)


# ---- loaders by extension

LOADERS = {".txt": read_tab_text, ".bin": read_frames, ".poly5": read_poly5}
_FIRST = dict(LOADERS)


def register_loader(extension: str, loader) -> None:
    if not extension.startswith("."):
        raise ValueError("an extension begins with a dot")
    LOADERS[extension.lower()] = loader


def unregister_loader(extension: str) -> None:
    LOADERS.pop(extension.lower(), None)


def reset_loaders() -> None:
    LOADERS.clear()
    LOADERS.update(_FIRST)


def load(spark: SparkSession, path: str, loader=None, **how) -> DataFrame:
    """Read a recording with a given loader, or the one of its extension."""
    if loader is None:
        extension = "." + path.rstrip("/*").rpartition(".")[2].lower()
        if extension not in LOADERS:
            raise ValueError(f"no loader for {extension!r}; known: {sorted(LOADERS)}")
        loader = LOADERS[extension]
    return loader(spark, path, **how)


def only_channel(labels: list[str]) -> str:
    """The only channel, or the only one that isn't an ECG."""
    rest = [c for c in labels if not any(x in c.lower() for x in ("ecg", "ekg"))]
    for found in (labels, rest):
        if len(found) == 1:
            return found[0]
    raise ValueError(f"name one of the channels {labels}")


def choose_channel(samples: DataFrame) -> str:
    """``only_channel`` of the labels in a table of samples."""
    return only_channel([r.channel for r in samples.select("channel").distinct().orderBy("channel").collect()])


def join_sequences(parts: list[DataFrame]) -> DataFrame:
    """Frames of consecutive files as one recording: ``part`` and a running ``frame_idx`` in file order.

    Adds ``gap`` (seconds since the file before) and ``in_order`` at each file's first frame.
    All frames take the first file's ``recording_id``, where files have one.
    """
    whole = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        whole = whole.unionByName(p.withColumn("part", F.lit(k)), allowMissingColumns=True)
    # one row a file gives the frames before it and the time at which the file before ends
    by_file = Window.orderBy("part")
    ids = [F.min(BY).alias("_id")] if BY in whole.columns else []
    files = whole.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.max_by("t", "frame_idx").alias("_last"), *ids)
    before = F.coalesce(F.sum("_n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = [F.first("_id", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(BY)] if ids else []
    files = files.select("part", before.alias("_before"), F.lag("_last").over(by_file).alias("_ended"), *first)
    whole = whole.drop(BY)
    number = F.row_number().over(Window.partitionBy("part").orderBy("frame_idx")) - 1
    placed = whole.withColumn("_number", number).join(files, "part")
    step = F.when(F.col("_number") == 0, F.col("t") - F.col("_ended"))
    return placed.withColumn("gap", step).withColumn("in_order", step > 0).withColumn("frame_idx", (F.col("_number") + F.col("_before")).cast("long")).drop("_number", "_before", "_ended")
