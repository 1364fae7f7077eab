"""Long recordings in chunks: ranges of samples, each with a halo of its neighbours' samples.

A recording is no longer one task's.  A chunk holds ``length`` consecutive idx and, on both
sides, ``halo`` more, which are computed and thrown away; whatever looks no further than the halo
gives the same values as on the whole recording, and a recursive filter does up to what is
left of its answer to an impulse after ``halo`` samples (``settled``).  idx are consecutive
within a recording.  A sample goes to one chunk, and to another for each halo it is in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pneumaspark.operators.kernels import iir

BY = "recording_id"
LENGTH = 1 << 18
CHUNK, OWN = "_chunk", "_own"


def spread(samples: DataFrame, length: int = LENGTH, halo: int = 0) -> DataFrame:
    """Samples with ``_chunk``, once for each chunk they are in or near, and ``_own``, whether they are in it."""
    if length < 1 or halo < 0:
        raise ValueError("a chunk has one sample or more, a halo none or more")
    at = F.floor(F.col("idx") / F.lit(length)).cast("long")
    around = F.sequence(F.floor((F.col("idx") - halo) / F.lit(length)).cast("long"), F.floor((F.col("idx") + halo) / F.lit(length)).cast("long")) if halo else F.array(at)
    return samples.withColumn(CHUNK, F.explode(around)).withColumn(OWN, F.col(CHUNK) == at)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


Kernel = Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]]


def map_chunks(samples: DataFrame, kernel: Kernel, names: tuple[str, ...], length: int = LENGTH, halo: int = 0, replace: bool = False) -> DataFrame:
    """Samples with the columns that ``kernel(idx, values)`` gives for them; nulls are NaN, and NaN becomes null.

    One shuffle by recording and chunk; a task streams its chunks, small recordings many to an
    Arrow batch.  ``replace``: the kernel's only column takes the place of ``value``.
    """
    kept = samples.drop("value") if replace else samples.drop(*names)
    first = kept.columns
    made_of = StructType([*kept.schema.fields, *(StructField("value" if replace else name, DoubleType()) for name in names)])
    arrow = to_arrow_schema(made_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        held = 0
        for table in _groups(batches, (BY, CHUNK)):
            own = table[OWN].to_numpy()
            if not own.any():
                continue
            idx, x = table["idx"].to_numpy(), table["_x"].to_numpy().astype(float)
            made = kernel(idx, x)
            rows = table.filter(pa.array(own)).select(first)
            for name in names:
                rows = rows.append_column("value" if replace else name, pa.array(np.asarray(made[name], float)[own], from_pandas=True))
            done.append(rows.cast(arrow))
            held += rows.num_rows
            if held >= 1 << 16:
                yield from pa.concat_tables(done).to_batches(1 << 16)
                done, held = [], 0
        if done:
            yield from pa.concat_tables(done).to_batches(1 << 16)

    # a copy of the value as a double, so that kernels see one kind; the recording's own columns pass through
    wide = spread(samples.withColumn("_x", F.col("value").cast("double")), length, halo)
    placed = wide.select(*first, "_x", CHUNK, OWN).repartition(BY, CHUNK).sortWithinPartitions(BY, CHUNK, "idx")
    return placed.mapInArrow(run, made_of)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int = 4096, halo: int = 0) -> DataFrame:
    """Frames with the pixels that ``kernel(frame_idx, grid)`` gives, chunk by chunk; a missing pixel is null, and NaN for the kernel.

    A chunk's frames have the same number of pixels; ``grid`` is (frame, pixel).
    """
    kept = frames.drop("pixels").columns
    made_of = StructType([*frames.drop("pixels").schema.fields, StructField("pixels", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(made_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, (BY, CHUNK)):
            own = table[OWN].to_numpy()
            if not own.any():
                continue
            flat = table["_grid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat) % table.num_rows:
                raise ValueError("frames of one recording differ in their number of pixels")
            grid = np.asarray(kernel(table["idx"].to_numpy(), flat.reshape(table.num_rows, -1)), float)[own]
            offsets = np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32) if grid.shape[1] else np.zeros(len(grid) + 1, np.int32)
            rows = table.filter(pa.array(own)).select(kept).append_column("pixels", pa.ListArray.from_arrays(offsets, pa.array(grid.ravel(), from_pandas=True)))
            yield from rows.cast(arrow).to_batches(1 << 10)

    wide = spread(frames.withColumns({"idx": F.col("frame_idx"), "_grid": F.col("pixels").cast("array<double>")}), length, halo)
    placed = wide.select(*kept, *([] if "idx" in kept else ["idx"]), "_grid", CHUNK, OWN).repartition(BY, CHUNK).sortWithinPartitions(BY, CHUNK, "frame_idx")
    return placed.mapInArrow(run, made_of).select(*frames.columns)


def reduce_frames(frames: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], Mapping[str, np.ndarray]], ddl: str, length: int = 4096, halo: int = 0) -> DataFrame:
    """Rows (recording_id, ...) that ``kernel(frame_idx, grid, own)`` gives for each chunk of frames; ``ddl`` names the columns after recording_id."""
    made_of = StructType([frames.schema[BY], *StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(made_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, (BY, CHUNK)):
            own = table[OWN].to_numpy()
            if not own.any():
                continue
            flat = table["_grid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            made = kernel(table["idx"].to_numpy(), flat.reshape(table.num_rows, -1), own)
            n = len(next(iter(made.values())))
            columns = [pa.repeat(table[BY][0], n), *(pa.array(made[f.name], from_pandas=True) for f in made_of.fields[1:])]
            yield from pa.table(columns, names=arrow.names).cast(arrow).to_batches(1 << 16)

    own_columns = frames.select(BY, F.col("frame_idx").alias("idx"), F.col("pixels").cast("array<double>").alias("_grid"))
    return spread(own_columns, length, halo).repartition(BY, CHUNK).sortWithinPartitions(BY, CHUNK, "idx").mapInArrow(run, made_of)


def in_chunks(samples: DataFrame, operator: Callable[[DataFrame], DataFrame], length: int = LENGTH, halo: int = 0) -> DataFrame:
    """A window operator that goes by recording_id, run by chunk: ``operator`` must keep rows and look no further than the halo."""
    kind = samples.schema[BY].dataType
    wide = spread(samples, length, halo).withColumn(BY, F.struct(F.col(BY).alias("id"), F.col(CHUNK).alias("chunk")))
    out = operator(wide).where(OWN)
    return out.withColumn(BY, F.col(f"{BY}.id").cast(kind)).drop(CHUNK, OWN)


def settled(sections: np.ndarray, left: float = 1e-13) -> int:
    """Samples after which a filter's answer to an impulse is below ``left`` of it, both ways together."""
    slowest = max((np.abs(np.roots([1, s[3], s[4]])).max() for s in sections), default=0.0)
    if slowest >= 1:
        raise ValueError("the filter doesn't settle")
    # sections with one slowest pole add up; two orders more for those
    return 64 if slowest == 0 else int(math.ceil(math.log(left * 1e-2) / math.log(slowest))) + 64


def zero_phase(samples: DataFrame, sections: np.ndarray, length: int = LENGTH) -> DataFrame:
    """Samples with their values filtered forward and backward, chunk by chunk."""
    return map_chunks(samples, lambda idx, x: {"value": iir.zero_phase(sections, x)}, ("value",), length, settled(sections), replace=True)


def harmonic_notch(samples: DataFrame, base: float, fs: float, top: float | None = None, distance: float | None = None, length: int = LENGTH) -> DataFrame:
    """Samples without the multiples of a frequency, chunk by chunk; each filter of the chain needs a halo of its own."""
    halo = sum(settled(sections) for sections in iir.harmonics(base, fs, top, distance))
    return map_chunks(samples, lambda idx, x: {"value": iir.harmonic_notch(x, base, fs, top, distance)}, ("value",), length, halo, replace=True)


def butterworth(samples: DataFrame, kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4, length: int = LENGTH) -> DataFrame:
    return zero_phase(samples, iir.butterworth(order, cutoff, fs, kind), length)
