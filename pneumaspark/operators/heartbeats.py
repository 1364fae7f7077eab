"""Heart beats of long recordings: ``ecg.estimated_subtraction`` in several passes, none of which holds a recording.

Samples are packed to blocks of ``BLOCK``, once; a task takes the blocks of a chunk and of its halo.

1. Chunks give the stretches in which the rectified band exceeds its threshold.  A run that a chunk's
   edge cuts is put together again from its stretches: their tops and lows are enough for its own.
2. The tops of runs go by in order, a row at a time, and of two too close the stronger stays.  A missing beat is looked
   for in the stretches of its gap alone.
3. Medians are the middle rows of a sort; sums of beats meet in the mean complex, whose copies chunks take away.

The settings and rules are those of the kernel, and so are the results, up to what a chunk's filter has left of its
answer to an impulse (``chunks.settled``) and the order of the mean's sum.  idx are consecutive within a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.operators import chunks
from pneumaspark.operators.kernels import ecg, iir
from pneumaspark.session import materialize

BY = "recording_id"
#: Samples of a block, and of a chunk of whole blocks.
BLOCK, LENGTH = 1 << 10, 1 << 16
#: Units in which gaps between beats meet the stretches within them.
BUCKET = 1 << 12
EPS = float(np.finfo(float).eps)


def blocks(samples: DataFrame) -> DataFrame:
    """Written (recording_id, start, x): up to BLOCK consecutive samples from idx ``start`` on."""
    rows = samples.groupBy(F.col(BY).cast("long").alias(BY), F.floor(F.col("idx") / F.lit(BLOCK)).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")))).alias("rows")
    )
    return materialize(rows.select(BY, F.col("rows")[0]["idx"].alias("start"), F.col("rows.value").alias("x")), "ecg_blocks")


def _recordings(packed: DataFrame) -> DataFrame:
    """(recording_id, first, n, range, reason): where a recording begins, its samples, and why it has no beats, if so."""
    bad = F.size(F.filter("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = packed.groupBy(BY).agg(
        F.min("start").alias("first"), F.sum(F.size("x")).alias("n"), (F.max(F.array_max("x")) - F.min(F.array_min("x"))).alias("range"), F.sum(bad).alias("bad")
    )
    poor = (F.col("n") < 3) | (F.col("bad") > 0) | F.coalesce(F.col("range") <= EPS, F.lit(True))
    return materialize(rows.select(BY, "first", "n", "range", F.when(poor, ecg.POOR_SIGNAL).alias("reason")), "ecg_recordings")


def _around(packed: DataFrame, length: int, halo: int) -> DataFrame:
    """Blocks with ``chunk``, once for each chunk that they overlap or that is within ``halo`` of them."""
    low, high = F.col("start") - halo, F.col("start") + F.size("x") - 1 + halo
    return packed.withColumn("chunk", F.explode(F.sequence(F.floor(low / F.lit(length)), F.floor(high / F.lit(length)))))


def _cut(table: pa.Table, length: int) -> tuple[int, np.ndarray, int, int]:
    """(first idx, values, begin and end of the chunk's own among them) of a chunk's blocks in order."""
    lo, chunk = table["start"][0].as_py(), table["chunk"][0].as_py()
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return lo, x, max(0, chunk * length - lo), min(len(x), (chunk + 1) * length - lo)


STRETCH = f"{BY} long, start long, end long, top long, top_value double, r long, xr double, q long, xq double, s long, xs double, strength array<double>"


def _stretches(packed: DataFrame, fs: float, how: ecg.Settings, length: int) -> DataFrame:
    """Written rows of STRETCH: stretches over the threshold within a chunk, with the top of the detection signal, of the signal itself (R), the
    lows before and after it (Q, S; null without one) and the detection signal."""
    sections = iir.butterworth(how.order, how.band, fs, "bandpass")
    width, interval, edge = how.samples(fs, how.smoothing), how.samples(fs, how.interval), how.samples(fs, how.threshold_smoothing)
    halo = chunks.settled(sections) + width + 3 * interval + edge

    def of_chunk(table: pa.Table) -> pa.RecordBatch | None:
        lo, x, a, b = _cut(table, length)
        if a >= b:
            return None
        detection = ecg.smooth(np.abs(iir.zero_phase(sections, x)), width) / table["range"][0].as_py()
        skip = (table["first"][0].as_py() - lo) % interval
        over = np.zeros(len(x), bool)
        over[skip:] = detection[skip:] > ecg.midrange(detection[skip:], interval, edge)
        over[:a] = over[b:] = False
        starts, ends = ecg.runs(over)
        if not len(starts):
            return None
        at, r = ecg.run_tops(detection, over), ecg.run_tops(x, over)
        on = np.flatnonzero(over)
        top_of = np.repeat(r, ends - starts)

        def lows(some: np.ndarray) -> tuple[pa.Array, pa.Array]:
            mask = np.zeros(len(x), bool)
            mask[some] = True
            found = ecg.run_tops(-x, mask)
            place, value = np.full(len(starts), np.nan), np.full(len(starts), np.nan)
            run = np.searchsorted(starts, found, side="right") - 1
            place[run], value[run] = found + lo, x[found]
            return pa.array(place, from_pandas=True).cast(pa.int64()), pa.array(value, from_pandas=True)

        q, xq = lows(on[on < top_of])
        s, xs = lows(on[on > top_of])
        strength = pa.ListArray.from_arrays(np.append(0, np.cumsum(ends - starts)).astype(np.int32), pa.array(detection[on]))
        columns = [pa.repeat(table[BY][0], len(starts)), *(pa.array(c) for c in (starts + lo, ends + lo, at + lo, detection[at], r + lo, x[r])), q, xq, s, xs, strength]
        return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in STRETCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks._groups(batches, (BY, "chunk")):
            made = of_chunk(table)
            if made is not None:
                yield made

    placed = _around(packed, length, halo).repartition(BY, "chunk").sortWithinPartitions(BY, "chunk", "start")
    return materialize(placed.mapInArrow(run, STRETCH), "ecg_stretches")


def _runs(stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written (recording_id, start, run), the run's first idx of each stretch, and (recording_id, run, end, top, top_value, r, xr, q, xq, s, xs) of whole runs."""
    w = Window.partitionBy(BY).orderBy("start")
    begins = F.when(F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True)), F.col("start"))
    rows = stretches.drop("strength").withColumn("_begin", begins)
    rows = materialize(rows.withColumn("run", F.last("_begin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin"), "ecg_parts")
    parts = rows.groupBy(BY, "run").agg(
        F.max("end").alias("end"),
        F.max(F.struct("top_value", (-F.col("top")).alias("back"))).alias("_top"),
        F.max(F.struct("xr", (-F.col("r")).alias("back"))).alias("_r"),
        F.collect_list(F.struct("start", "end", "r", "xr", "q", "xq", "s", "xs")).alias("parts"),
    )
    r = -F.col("_r.back")

    def low(p: Column, value: str, place: str) -> Column:
        return F.when(p[place].isNotNull(), F.struct(p[value].alias("v"), p[place].alias("at")))

    def least(p: Column) -> Column:
        return F.array_min(F.array(low(p, "xq", "q"), low(p, "xr", "r"), low(p, "xs", "s")))

    before = F.array_min(F.transform("parts", lambda p: F.when(p["end"] <= r, least(p)).when(p["start"] <= r, low(p, "xq", "q"))))
    after = F.array_min(F.transform("parts", lambda p: F.when(p["start"] > r, least(p)).when(p["end"] > r, low(p, "xs", "s"))))
    whole = parts.withColumns({"_q": before, "_s": after}).select(
        BY, "run", "end", (-F.col("_top.back")).alias("top"), F.col("_top.top_value").alias("top_value"), r.alias("r"), F.col("_r.xr").alias("xr"),
        F.col("_q.at").alias("q"), F.col("_q.v").alias("xq"), F.col("_s.at").alias("s"), F.col("_s.v").alias("xs"),
    )
    return rows.select(BY, "start", "run"), materialize(whole, "ecg_runs")


def _median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(recording_id, name): the mean of the middle one or two values that aren't null."""
    there = rows.where(F.col(value).isNotNull()).select(BY, F.col(value).cast("double").alias("_v"))
    placed = there.withColumn("_k", F.row_number().over(Window.partitionBy(BY).orderBy("_v")))
    middle = placed.join(there.groupBy(BY).agg(F.count(F.lit(1)).alias("_n")), BY)
    return middle.where(F.col("_k").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)).groupBy(BY).agg(F.avg("_v").alias(name))


def _period(rows: DataFrame, at: str, name: str) -> DataFrame:
    w = Window.partitionBy(BY).orderBy(at)
    return _median(rows.withColumn("_step", F.col(at) - F.lag(at).over(w)), "_step", name)


def _steady(runs: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Written (recording_id, run, place) of the beats that stay of those too close, and (recording_id, period) counted anew."""
    schema = pa.schema([(BY, pa.int64()), ("run", pa.int64()), ("place", pa.int64())])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or row[0] != last[0] or row[2] - last[2] >= row[4]:
                    if last is not None:
                        out.append(last[:3])
                    last = row
                elif row[3] > last[3]:
                    last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in last[:3]], schema=schema)

    first = materialize(_period(runs, "top", "period"), "ecg_periods")
    least = first.select(BY, "period", F.greatest(F.lit(1.0), (1 - tolerance) * F.col("period")).alias("least"))
    tops = runs.select(BY, "run", "top", "top_value").join(least.select(BY, "least"), BY).select(BY, "run", "top", "top_value", "least")
    kept = materialize(tops.repartition(BY).sortWithinPartitions(BY, "top").mapInArrow(stay, f"{BY} long, run long, place long"), "ecg_kept")
    periods = first.join(_period(kept, "place", "again"), BY, "left").select(BY, F.coalesce("again", "period").alias("period"))
    return kept, materialize(periods, "ecg_periods")


def _missing(kept: DataFrame, periods: DataFrame, stretches: DataFrame, tolerance: float) -> DataFrame:
    """Written (recording_id, start) of the stretch of each beat that was missing, once a beat."""
    w = Window.partitionBy(BY).orderBy("place")
    gaps = kept.withColumn("following", F.lead("place").over(w)).join(periods, BY)
    gaps = gaps.where(F.col("following") - F.col("place") > (1 + tolerance) * F.col("period")).select(BY, "place", "following", "period")

    def bucket(at: Column) -> Column:
        return F.floor(at / F.lit(BUCKET)).cast("long")

    wide = gaps.withColumn("_b", F.explode(F.sequence(bucket(F.col("place")), bucket(F.col("following")))))
    parts = stretches.select(BY, "start", "end", "strength").withColumn("_b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    met = parts.join(wide, [BY, "_b"]).where((F.col("start") < F.col("following")) & (F.col("end") - 1 > F.col("place")) & (F.col("_b") == bucket(F.greatest("start", "place"))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks._groups(batches, (BY, "place")):
            place, following, period = (table[c][0].as_py() for c in ("place", "following", "period"))
            starts = table["start"].to_numpy()
            sizes = table["end"].to_numpy() - starts
            strength = table["strength"].combine_chunks().flatten().to_numpy()
            of = np.repeat(np.arange(len(starts)), sizes)
            at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = []
            while following - place > (1 + tolerance) * period:
                a = max(place + 1, round(place + period - tolerance * period))
                i, j = np.searchsorted(at, [a, min(following, round(place + period + tolerance * period) + 1)])
                if i >= j:
                    break
                k = i + int(np.argmax(strength[i:j]))
                place = int(at[k])
                found.append(int(starts[of[k]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.repeat(table[BY][0], len(found)), pa.array(found, pa.int64())], [BY, "start"])

    placed = met.select(BY, "place", "start", "end", "strength", "following", "period").repartition(BY, "place").sortWithinPartitions(BY, "place", "start")
    return materialize(placed.mapInArrow(look, f"{BY} long, start long"), "ecg_missing")


def heart_beats(packed: DataFrame, fs: float, length: int = LENGTH, **how) -> tuple[DataFrame, DataFrame]:
    """Of ``blocks``: (recording_id, q_idx, r_idx, s_idx, xq, xr, xs, restored) of the complexes of each template, and
    (recording_id, first, n, range, reason) of the recordings; the reason says why a recording's ECG can't be estimated, else it is null."""
    s = ecg.Settings(**how)
    s.check(fs)
    recordings = _recordings(packed)
    fit = recordings.where("reason is null").select(BY, "first", "n", "range")
    stretches = _stretches(packed.join(fit, BY), fs, s, length)
    run_of, runs = _runs(stretches)
    kept, periods = _steady(runs, s.tolerance)
    missing = _missing(kept, periods, stretches, s.tolerance).join(run_of, [BY, "start"])
    beats = kept.select(BY, "run", F.lit(False).alias("restored")).unionByName(missing.select(BY, "run", F.lit(True).alias("restored")))
    half = s.samples(fs, s.window) // 2
    tops = beats.groupBy(BY, "run").agg(F.count(F.lit(1)).alias("times"), F.max("restored").alias("restored")).join(runs, [BY, "run"]).join(fit, BY)
    inside = (F.col("end") - F.col("run") >= 3) & (F.col("r") > F.col("run")) & (F.col("r") < F.col("end") - 1)
    inside &= (F.col("r") - half >= F.col("first")) & (F.col("r") + half + 1 <= F.col("first") + F.col("n"))
    up, down = F.col("xr") - F.col("xq"), F.col("xr") - F.col("xs")
    # a beat that shares its run with another has the same complex once more
    rows = tops.where(inside & (up > EPS) & (down > EPS)).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rows = materialize(rows.select(BY, F.col("q").alias("q_idx"), F.col("r").alias("r_idx"), F.col("s").alias("s_idx"), "xq", "xr", "xs", "restored"), "ecg_complexes")
    scales = _median(rows.select(BY, up.alias("up")), "up", "_up").join(_median(rows.select(BY, down.alias("down")), "down", "_down"), BY)
    large = (up >= ecg.LEAST_SCALE * F.col("_up")) & (down >= ecg.LEAST_SCALE * F.col("_down"))
    rows = materialize(rows.join(scales, BY).where(large).drop("_up", "_down"), "ecg_complexes")

    def with_number(df: DataFrame, counted: DataFrame, name: str) -> DataFrame:
        return df.join(counted.groupBy(BY).agg(F.count(F.lit(1)).alias(name)), BY, "left")

    told = with_number(with_number(recordings, runs, "_tops"), rows, "_whole").join(_period(rows, "r_idx", "_period"), BY, "left")
    n_tops, n_whole, seconds = F.coalesce("_tops", F.lit(0)), F.coalesce("_whole", F.lit(0)), F.col("_period") / fs
    odd = F.lit(False)
    if s.shortest is not None:
        odd |= seconds < s.shortest
    if s.longest is not None:
        odd |= seconds > s.longest
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(n_tops < max(s.fewest, 2), F.concat(n_tops.cast("string"), F.lit(f" beats were found; {s.fewest} are needed")))
        .when(n_whole < s.fewest, F.concat(n_whole.cast("string"), F.lit(f" whole QRS complexes were found; {s.fewest} are needed")))
        .when(odd, F.format_string("a median interval of %.3f s between beats isn't plausible", seconds))
    )
    return rows, materialize(told.select(BY, "first", "n", "range", reason.alias("reason")), "ecg_recordings")


def _refuse(recordings: DataFrame) -> None:
    for row in recordings.where("reason is not null").orderBy(BY).limit(1).collect():
        raise ValueError(f"recording {row[BY]}: {row.reason}")


def complexes(samples: DataFrame, fs: float, length: int = LENGTH, **how) -> DataFrame:
    """(recording_id, q_idx, r_idx, s_idx, restored): the complexes that make up each recording's template.  Raises ValueError where it can't be estimated."""
    rows, recordings = heart_beats(blocks(samples), fs, length, **how)
    _refuse(recordings)
    return rows.select(BY, "q_idx", "r_idx", "s_idx", "restored")


def subtract(samples: DataFrame, fs: float, strict: bool = True, length: int = LENGTH, **how) -> DataFrame:
    """(recording_id, idx, value, reason): samples less their recording's estimated ECG.

    A recording in which it can't be estimated raises ValueError, or, unless ``strict``, comes
    back as it is with the reason.
    """
    s = ecg.Settings(**how)
    packed = blocks(samples)
    rows, recordings = heart_beats(packed, fs, length, **how)
    if strict:
        _refuse(recordings)
    half = s.samples(fs, s.window) // 2
    around = np.arange(-half, half + 1)
    out = None if s.output_band is None else iir.butterworth(s.output_order, s.output_band, fs, "bandpass")
    halo = 2 * half + (0 if out is None else chunks.settled(out))
    good = recordings.where("reason is null").select(BY)
    beats = rows.join(good, BY).groupBy(BY, "r_idx").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("xq", "xr", "xs")])
    near = F.sequence(F.floor((F.col("r_idx") - halo) / F.lit(length)), F.floor((F.col("r_idx") + halo) / F.lit(length)))
    beats = materialize(beats.withColumn("chunk", F.explode(near)), "ecg_beats")

    def scaled(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(R, times, foot, scale) of a chunk's beats; foot and scale for each place around R."""
        r, times, xq, xr, xs = (table[c].to_numpy().astype(t) for c, t in (("r_idx", int), ("times", float), ("xq", float), ("xr", float), ("xs", float)))
        foot = np.where(around >= 0, xs[:, None], xq[:, None])
        return r, times, foot, xr[:, None] - foot

    def total(blocks: pa.Table, beats: pa.Table) -> pa.Table:
        empty = pa.table({BY: pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "total": pa.array([], pa.float64()), "times": pa.array([], pa.float64())})
        if not blocks.num_rows or not beats.num_rows:
            return empty
        blocks = blocks.sort_by("start")
        lo, x, a, b = _cut(blocks, length)
        r, times, foot, scale = scaled(beats.sort_by("r_idx"))
        own = (r >= lo + a) & (r < lo + b)
        if not own.any():
            return empty
        made = (x[r[own, None] - lo + around] - foot[own]) / scale[own] * times[own, None]
        places = pa.array(np.arange(len(around)), pa.int32())
        return pa.table({BY: pa.repeat(blocks[BY][0], len(around)), "place": places, "total": made.sum(axis=0), "times": pa.repeat(times[own].sum(), len(around))})

    def grouped(df: DataFrame):
        return df.groupBy(BY, "chunk")

    wide = _around(packed, length, halo)
    totals = grouped(wide).cogroup(grouped(beats)).applyInArrow(total, f"{BY} long, place int, total double, times double")
    means = totals.groupBy(BY, "place").agg((F.sum("total") / F.sum("times")).alias("mean"))
    templates = materialize(means.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("t")).select(BY, F.col("t.mean").alias("template")), "ecg_templates")

    def clean(blocks: pa.Table, beats: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("start")
        lo, x, a, b = _cut(blocks, length) if blocks.num_rows else (0, np.empty(0), 0, 0)
        if a >= b:
            return pa.table({BY: pa.array([], pa.int64()), "idx": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        template = blocks["template"][0].as_py()
        if template is not None:
            sums, counts = np.zeros(len(x)), np.zeros(len(x))
            if beats.num_rows:
                r, times, foot, scale = scaled(beats.sort_by("r_idx"))
                cells = r[:, None] - lo + around
                there = (cells >= 0) & (cells < len(x))
                np.add.at(sums, cells[there], ((np.array(template) * scale + foot) * times[:, None])[there])
                np.add.at(counts, cells[there], np.broadcast_to(times[:, None], cells.shape)[there])
            estimate = np.divide(sums, counts, out=np.zeros(len(x)), where=counts > 0)
            if out is not None and s.output_stage == "before_subtraction":
                x = iir.zero_phase(out, x) - estimate
            else:
                x = x - estimate if out is None else iir.zero_phase(out, x - estimate)
        return pa.table({BY: pa.repeat(blocks[BY][0], b - a), "idx": pa.array(np.arange(lo + a, lo + b)), "value": pa.array(x[a:b], from_pandas=True)})

    cleaned = grouped(wide.join(templates, BY, "left")).cogroup(grouped(beats)).applyInArrow(clean, f"{BY} long, idx long, value double")
    return cleaned.join(recordings.select(BY, "reason"), BY)
