"""Binary recordings as Python data sources: frame files and Poly5 files, by ranges of their bytes.

``recording_frames`` and ``poly5`` read a file with as many tasks as it has ranges of
``task_bytes``; ``first`` and ``most`` prune ranges before any byte is read.  Both also
write: a file for each recording, streamed, under a name of the task's attempt, and listed
in the folder's manifest once all tasks are done.  ``poly5_heads`` reads heads alone.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pneumaspark.sources import storage

TASK_BYTES = 64 << 20
#: Bytes read at a time within a task.
READ_BYTES = 4 << 20

# ---- binary frames: fixed values of the format, little endian
FRAME_HEAD, FRAME_PIXELS, FRAME_TAIL, TEXT_BYTES = "<df", 1024, "<ii", 30


def frame_dtype(n_extra: int) -> np.dtype:
    return np.dtype(
        [("day", "<f8"), ("unused", "<f4"), ("pixels", "<f4", FRAME_PIXELS), ("min_max", "<i4"), ("marker", "<i4"), ("text", f"S{TEXT_BYTES}"), ("timing_error", "<i4"), ("extra", "<f4", n_extra)]
    )


def frame_size(n_extra: int) -> int:
    return frame_dtype(n_extra).itemsize


def pack_frames(t: np.ndarray, pixels: np.ndarray, min_max=None, marker=None, text=None, extra: np.ndarray | None = None) -> bytes:
    """Frames as bytes: time as a fraction of a day, 32 x 32 pixels, flags, event text, extra channels."""
    extra = np.zeros((len(t), 52), np.float32) if extra is None else extra
    out = np.zeros(len(t), frame_dtype(extra.shape[1]))
    out["day"], out["pixels"], out["extra"] = np.asarray(t) / 86400, pixels.reshape(len(t), -1), extra
    out["min_max"], out["marker"] = 0 if min_max is None else min_max, 0 if marker is None else marker
    if text is not None:
        out["text"] = text
    return out.tobytes()


def lists(values: np.ndarray) -> pa.ListArray:
    """A two-dimensional array as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32), np.ascontiguousarray(values, float).ravel())


FRAMES = pa.schema([
    ("path", pa.string()), ("frame_idx", pa.int64()), ("t", pa.float64()), ("min_max", pa.int32()), ("marker", pa.int32()),
    ("text", pa.string()), ("pixels", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64())),
])


class FrameReader(DataSourceReader):
    def __init__(self, path: str, n_extra: int, first: int, most: int | None, task_bytes: int):
        self.path, self.n_extra, self.first, self.most, self.task_bytes = path, n_extra, first, most, task_bytes

    def partitions(self) -> list[InputPartition]:
        size, out = frame_size(self.n_extra), []
        per_task = max(1, self.task_bytes // size)
        for uri, length in storage.listed(self.path):
            if length % size:
                raise ValueError(f"{uri}: {length} bytes aren't whole frames of {size}")
            end = length // size if self.most is None else min(length // size, self.first + self.most)
            out += [InputPartition((uri, a, min(a + per_task, end))) for a in range(self.first, end, per_task)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        (uri, first, end), kind = partition.value, frame_dtype(self.n_extra)
        system, inner, _ = storage.opened(uri)
        step = max(1, READ_BYTES // kind.itemsize)
        with system.open_input_file(inner) as source:
            for a in range(first, end, step):
                n = min(step, end - a)
                f = np.frombuffer(source.read_at(n * kind.itemsize, a * kind.itemsize), kind)
                text = [x.decode("ascii", "replace") for x in f["text"].tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(uri), n), pa.array(np.arange(a, a + n)), pa.array(f["day"] * 86400), pa.array(f["min_max"].astype(np.int32)), pa.array(f["marker"].astype(np.int32)),
                    pa.array(text), lists(f["pixels"].astype(float)), lists(f["extra"].astype(float)),
                ], schema=FRAMES)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RecordingWriter(DataSourceArrowWriter):
    """Writes rows in order of recording_id, their first column: a file for each recording."""

    suffix = ""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def begin(self, out, batch: pa.RecordBatch) -> None:
        """Write what comes before a recording's rows."""

    def rows(self, out, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def end(self, out) -> None:
        """Write what is still held of a recording."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder, _ = storage.opened(self.path)
        names, out, last = [], None, None
        for batch in iterator:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if out is None or ids[a] != last:
                    if out is not None:
                        self.end(out)
                        out.close()
                    last = ids[a]
                    system.create_dir(folder, recursive=True)
                    names.append(f"recording-{last}-{uuid.uuid4().hex}{self.suffix}")
                    out = system.open_output_stream(f"{folder}/{names[-1]}")
                    self.begin(out, part)
                self.rows(out, part)
        if out is not None:
            self.end(out)
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        storage.commit(self.path, [name for m in messages if m is not None for name in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        storage.remove(self.path, [name for m in messages if m is not None for name in m.names])


def table_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as a two-dimensional array; a value that is missing is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"lists of {width} values are needed")
    return flat.reshape(len(column), width)


class FrameWriter(RecordingWriter):
    suffix = ".bin"

    def __init__(self, path: str, n_extra: int):
        super().__init__(path)
        self.n_extra = n_extra

    def rows(self, out, batch: pa.RecordBatch) -> None:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        text = [x.encode("ascii", "replace")[:TEXT_BYTES] for x in c["text"].to_pylist()]
        numbers = {k: c[k].to_numpy(zero_copy_only=False) for k in ("t", "min_max", "marker")}
        out.write(pack_frames(numbers["t"], table_of(c["pixels"], FRAME_PIXELS), numbers["min_max"], numbers["marker"], text, table_of(c["extra"], self.n_extra)))


class FrameFiles(DataSource):
    """``spark.read.format("recording_frames")``; options n_extra, first, most, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "recording_frames"

    def schema(self) -> str:
        return "path string, frame_idx long, t double, min_max int, marker int, text string, pixels array<double>, extra array<double>"

    def reader(self, schema) -> FrameReader:
        o = self.options
        return FrameReader(o["path"], int(o.get("n_extra", 52)), int(o.get("first", 0)), int(o["most"]) if "most" in o else None, int(o.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], int(self.options.get("n_extra", 52)))


# ---- Poly5, version 2.03: fixed values of the format, little endian
POLY_HEAD, POLY_ID, CHANNEL_BYTES, BLOCK_HEAD, BLOCK_SAMPLES = 217, b"POLY SAMPLE FILEversion 2.03\r\n\x1a", 136, 86, 256
POLY_FIELDS, CHANNEL_FIELDS, BLOCK_FIELDS = "<H81shhBHi4xHHHHHHHiHHH", "<41s4x11sffffh62x", "<i4xHHHHHHH64x"


def poly5_start(fs: int, labels: list[str], units: list[str], n: int) -> bytes:
    """All that comes before the blocks; each channel takes two descriptors."""
    name, blocks = b"recording", -(-n // BLOCK_SAMPLES)
    head = POLY_ID + struct.pack(POLY_FIELDS, 203, bytes([len(name)]) + name, fs, fs, 0, 2 * len(labels), n, 2024, 1, 1, 1, 0, 0, 0, blocks, BLOCK_SAMPLES, len(labels) * BLOCK_SAMPLES * 4, 0)
    out = [head.ljust(POLY_HEAD, b"\0")[:POLY_HEAD]]
    for label, unit in zip(labels, units, strict=True):
        for part in (b"(Lo) ", b"(Hi) "):
            text, short = (part + label.encode("latin-1", "replace"))[:40], unit.encode()[:10]
            out.append(struct.pack(CHANNEL_FIELDS, bytes([len(text)]) + text, bytes([len(short)]) + short, -1000.0, 1000.0, -1000.0, 1000.0, 0))
    return b"".join(out)


def poly5_block(number: int, values: np.ndarray) -> bytes:
    """A block of (sample, channel) values, filled up with zeros."""
    padded = np.zeros((BLOCK_SAMPLES, values.shape[1]), "<f4")
    padded[: len(values)] = values
    return struct.pack(BLOCK_FIELDS, number * BLOCK_SAMPLES, 2024, 1, 1, 1, 0, 0, 0) + padded.tobytes()


def pack_poly5(array: np.ndarray, fs: int, labels: list[str], units: list[str]) -> bytes:
    """A (channel, sample) array as a Poly5 file; samples are 32-bit floats."""
    blocks = range(0, array.shape[1], BLOCK_SAMPLES)
    return poly5_start(fs, labels, units, array.shape[1]) + b"".join(poly5_block(k, array[:, a : a + BLOCK_SAMPLES].T) for k, a in enumerate(blocks))


@dataclass
class Poly5Head:
    """What a file's head says; blocks begin at ``at``, ``step`` bytes apart."""

    fs: float
    labels: list[str]
    units: list[str]
    n: int
    per_block: int
    at: int
    step: int

    @classmethod
    def of(cls, uri: str) -> "Poly5Head":
        system, inner, _ = storage.opened(uri)
        with system.open_input_file(inner) as source:
            start = source.read_at(POLY_HEAD, 0)
            if len(start) < POLY_HEAD or not start.startswith(POLY_ID[:16]):
                raise ValueError(f"{uri} isn't a Poly5 file")
            fields = struct.unpack_from(POLY_FIELDS, start, len(POLY_ID))
            fs, n_double, n, per_block = fields[2], fields[5], fields[6], fields[15]
            table = source.read_at(CHANNEL_BYTES * n_double, POLY_HEAD)
        labels, units = [], []
        for k in range(0, n_double, 2):
            label, unit = struct.unpack_from("<41s4x11s", table, CHANNEL_BYTES * k)
            labels.append(label[1 : 1 + label[0]].decode("latin-1")[5:])
            units.append(unit[1 : 1 + unit[0]].decode("utf-8", "replace"))
        return cls(float(fs), labels, units, n, per_block, POLY_HEAD + CHANNEL_BYTES * n_double, BLOCK_HEAD + 4 * per_block * len(labels))


def heads(path: str) -> list[tuple[str, Poly5Head]]:
    """The heads of a path's files, a few hundred bytes of each, read side by side."""
    uris = [uri for uri, _ in storage.listed(path)]
    with ThreadPoolExecutor(16) as pool:
        return list(zip(uris, pool.map(Poly5Head.of, uris), strict=True))


POLY_ROWS = pa.schema([("path", pa.string()), ("channel", pa.string()), ("unit", pa.string()), ("fs", pa.float64()), ("idx", pa.int64()), ("t", pa.float64()), ("value", pa.float64())])


class Poly5Reader(DataSourceReader):
    def __init__(self, path: str, first: int, most: int | None, channels: list[str] | None, task_bytes: int):
        self.path, self.first, self.most, self.channels, self.task_bytes = path, first, most, channels, task_bytes

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri, head in heads(self.path):
            end = head.n if self.most is None else min(head.n, self.first + self.most)
            per_task = max(1, self.task_bytes // head.step) * head.per_block
            a = self.first
            while a < end:  # ranges end where blocks do
                b = min(end, (a // per_task + 1) * per_task)
                out.append(InputPartition((uri, head, a, b)))
                a = b
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        uri, head, first, end = partition.value
        width, system, inner = len(head.labels), *storage.opened(uri)[:2]
        wanted = [k for k, label in enumerate(head.labels) if self.channels is None or label in self.channels]
        blocks = max(1, READ_BYTES // head.step)
        with system.open_input_file(inner) as source:
            for k in range(first // head.per_block, -(-end // head.per_block), blocks):
                z = min(k + blocks, -(-end // head.per_block))
                data = np.frombuffer(source.read_at((z - k) * head.step, head.at + k * head.step), np.uint8).reshape(z - k, head.step)
                values = np.ascontiguousarray(data[:, BLOCK_HEAD:]).view("<f4").reshape(-1, width)
                a, b = max(first, k * head.per_block), min(end, z * head.per_block)
                idx = np.arange(a, b)
                for c in wanted:
                    own = values[a - k * head.per_block : b - k * head.per_block, c].astype(float)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.repeat(pa.scalar(x), len(idx)) for x in (uri, head.labels[c], head.units[c], head.fs)), pa.array(idx), pa.array(idx / head.fs), pa.array(own)], schema=POLY_ROWS
                    )


def packed_runs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (recording, run, values) in order to a row for each run, with its values as little-endian floats."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["recording_id", "run", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            recording, run = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            values = table_of(batch.column(2), width).astype("<f4")
            cuts = [0, *(np.flatnonzero((recording[1:] != recording[:-1]) | (run[1:] != run[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (int(recording[a]), int(run[a]))
                if held and key != last:
                    yield row()
                    held = []
                last = key
                held.append(values[a:b].tobytes())
        if held:
            yield row()

    return pack


class Poly5Writer(RecordingWriter):
    suffix = ".poly5"

    def __init__(self, path: str, fs: float, channels: dict[str, str]):
        super().__init__(path)
        self.fs, self.channels = int(fs), channels

    def begin(self, out, batch: pa.RecordBatch) -> None:
        out.write(poly5_start(self.fs, list(self.channels), list(self.channels.values()), batch.column(1)[0].as_py()))
        self.held, self.number = np.empty((0, len(self.channels))), 0

    def rows(self, out, batch: pa.RecordBatch) -> None:
        width = len(self.channels)
        values = np.concatenate([self.held, *(np.frombuffer(x.as_buffer(), "<f4").reshape(-1, width).astype(float) for x in batch.column(2))])
        cut = len(values) - len(values) % BLOCK_SAMPLES
        for a in range(0, cut, BLOCK_SAMPLES):
            out.write(poly5_block(self.number, values[a : a + BLOCK_SAMPLES]))
            self.number += 1
        self.held = values[cut:]

    def end(self, out) -> None:
        if len(self.held):
            out.write(poly5_block(self.number, self.held))


class Poly5Files(DataSource):
    """``spark.read.format("poly5")``; options first, most, channels (a JSON list), task_bytes; to write, fs and channels (units by label)."""

    @classmethod
    def name(cls) -> str:
        return "poly5"

    def schema(self) -> str:
        return "path string, channel string, unit string, fs double, idx long, t double, value double"

    def reader(self, schema) -> Poly5Reader:
        o = self.options
        return Poly5Reader(o["path"], int(o.get("first", 0)), int(o["most"]) if "most" in o else None, json.loads(o["channels"]) if "channels" in o else None, int(o.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> Poly5Writer:
        return Poly5Writer(self.options["path"], float(self.options["fs"]), json.loads(self.options["channels"]))


class HeadsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        uris = [uri for uri, _ in storage.listed(self.path)]
        return [InputPartition(uris[k : k + 100]) for k in range(0, len(uris), 100)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri in partition.value:
            head = Poly5Head.of(uri)
            for k, (label, unit) in enumerate(zip(head.labels, head.units, strict=True)):
                yield uri, label, k, unit, head.fs, head.n


class Poly5Heads(DataSource):
    """``spark.read.format("poly5_heads")``: the channels of Poly5 files."""

    @classmethod
    def name(cls) -> str:
        return "poly5_heads"

    def schema(self) -> str:
        return "path string, channel string, number int, unit string, fs double, n_samples long"

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options["path"])
