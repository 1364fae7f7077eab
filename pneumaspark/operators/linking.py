"""Matching events of several modalities on a shared clock, and timing between them.

Events are (recording_id, modality, event_id, t); links are wide rows with one
time per modality.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = "recording_id"
DEFAULT_TOLERANCE = 0.5
PIECE = 10_000  # events of a recording that are linked in one group, or more where no gap cuts them


def shift(events: DataFrame, seconds: float, columns: Sequence[str] = ("t",)) -> DataFrame:
    """Add an offset to time columns; indices stay."""
    return events.withColumns({c: F.col(c) + F.lit(float(seconds)) for c in columns})


def shift_by_modality(events: DataFrame, offsets: Mapping[str, float], columns: Sequence[str] = ("t",)) -> DataFrame:
    """Add each modality's offset, 0 where it has none."""
    known = F.create_map(*[x for m, s in offsets.items() for x in (F.lit(m), F.lit(float(s)))]) if offsets else None
    by = F.coalesce(F.try_element_at(known, F.col("modality")), F.lit(0.0)) if offsets else F.lit(0.0)
    return events.withColumns({c: F.col(c) + by for c in columns})


def offsets_from_timestamps(reference: str, timestamps: Mapping[str, float]) -> dict[str, float]:
    """Each modality's time less the reference's."""
    if reference not in timestamps:
        raise ValueError(f"no timestamp for the reference modality {reference!r}")
    return {m: t - timestamps[reference] for m, t in timestamps.items()}


def reference_modality(available: Sequence[str], wanted: str | None = None, order: Sequence[str] = ("ventilator", "eit", "emg")) -> str:
    """The wanted modality, or the first of the usual order that is there."""
    if wanted is not None:
        if wanted not in available:
            raise ValueError(f"modality {wanted!r} isn't loaded")
        return wanted
    for m in order:
        if m in available:
            return m
    raise ValueError("no modality is loaded")


def shared_clock(samples: DataFrame, starts: DataFrame) -> DataFrame:
    """Samples with ``shared_t`` = t - the recording's first t + its start (recording_id, start_time; 0 if absent)."""
    first = F.min("t").over(Window.partitionBy(BY))
    return samples.withColumn("_first", first).join(starts, BY, "left").withColumn("shared_t", F.col("t") - F.col("_first") + F.coalesce("start_time", F.lit(0.0))).drop("_first", "start_time")


def mutual_nearest(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(recording_id, left_t, right_t, confidence): pairs that are each other's nearest within the tolerance.

    Nearest neighbours on both sides come from ``closest_event``; the pairs are an
    equi-join of the two results, so the cost is linear in the events.
    """
    from pneumaspark.operators.peaks import closest_event

    a = closest_event(left, right).select(BY, F.col("t").alias("left_t"), F.col("nearest").alias("right_t"))
    b = closest_event(right, left).select(BY, F.col("t").alias("right_t"), F.col("nearest").alias("left_t"))
    both = a.join(b, [BY, "left_t", "right_t"])
    gap = F.abs(F.col("left_t") - F.col("right_t"))
    confidence = F.lit(1.0) if tolerance == 0 else F.greatest(F.lit(0.0), 1 - gap / tolerance)
    return both.where(gap <= tolerance).select(BY, "left_t", "right_t", confidence.alias("confidence"))


def in_pieces(events: DataFrame, tolerance: float, by: str = BY) -> DataFrame:
    """Events with ``piece``: about PIECE neighbours in time, cut only where two events are further apart than the tolerance.

    No link crosses such a gap, so pieces of a long recording are linked apart from each other.
    """
    w = Window.partitionBy(by).orderBy("t")
    apart = F.coalesce(F.col("t") - F.lag("t").over(w) > tolerance, F.lit(True))
    numbered = events.withColumns({"_apart": apart, "_number": F.row_number().over(w)})
    piece = F.max(F.when(F.col("_apart"), F.floor(F.col("_number") / PIECE))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("piece", piece.cast("long")).drop("_apart", "_number")


def _nearest_free(times: list[float], used: list[bool], t: float, tolerance: float) -> tuple[float, int] | None:
    """(distance, place) of the nearest unused time within the tolerance, the earlier on a tie."""
    best, middle = None, bisect_left(times, t)
    for places in (range(middle - 1, -1, -1), range(middle, len(times))):
        for j in places:
            gap = abs(times[j] - t)
            if not gap <= tolerance or (best and gap > best[0]):
                break
            if not used[j] and (best is None or (gap, j) < best):
                best = (gap, j)
    return best


def link_greedy(events: DataFrame, modalities: Sequence[str], tolerance: float = DEFAULT_TOLERANCE, by: str = BY, carry: Sequence[str] = ()) -> DataFrame:
    """Greedy links of a recording's events: (recording_id, link_no, one time per modality, confidence).

    Modalities are taken in order, their events by time; each unused event takes the
    nearest unused one of every other modality within the tolerance.  Singletons
    have a null confidence.  A piece of a recording is one group, see ``in_pieces``.
    ``by``: what events have in common to be linked, such as a session.  ``carry``: columns of
    the events that each modality's event brings along, as name_modality.
    """
    names = [f"t_{m}" for m in modalities]
    carried = [f"{c}_{m}" for m in modalities for c in carry]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["modality", "t", "event_id"])
        own = {m: pdf.loc[pdf["modality"] == m] for m in modalities}
        left = {m: list(own[m]["t"]) for m in modalities}
        used = {m: [False] * len(left[m]) for m in modalities}
        found = []
        for m in modalities:
            for k, t in enumerate(left[m]):
                if used[m][k]:
                    continue
                used[m][k] = True
                row, worst = {m: k}, 0.0
                for o in modalities:
                    free = _nearest_free(left[o], used[o], t, tolerance) if o != m else None
                    if free:
                        gap, j = free
                        used[o][j] = True
                        row[o] = j
                        worst = max(worst, gap)
                conf = None if len(row) == 1 else 1.0 if tolerance == 0 else max(0.0, 1 - worst / tolerance)
                found.append((row, conf))
        times = [[left[m][row[m]] if m in row else None for m in modalities] for row, _ in found]
        order = sorted(range(len(found)), key=lambda k: next(v for v in times[k] if v is not None))
        out = {by: pdf[by].iloc[0], "piece": pdf["piece"].iloc[0], "n": np.arange(len(found))}
        out |= {f"t_{m}": [times[k][j] for k in order] for j, m in enumerate(modalities)}
        for m in modalities:
            for c in carry:
                values = own[m][c].tolist()
                out[f"{c}_{m}"] = [values[found[k][0][m]] if m in found[k][0] else None for k in order]
        return pd.DataFrame(out | {"confidence": [found[k][1] for k in order]}, dtype=object)

    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    ddl = f"{by} {kind[by]}, piece long, n long, " + ", ".join([*(f"{n} double" for n in names), *(f"{c}_{m} {kind[c]}" for m in modalities for c in carry)]) + ", confidence double"
    linked = in_pieces(events.select(by, "modality", "event_id", "t", *[c for c in carry if c != "event_id"]), tolerance, by).groupBy(by, "piece").applyInPandas(link, ddl)
    number = F.row_number().over(Window.partitionBy(by).orderBy("piece", "n")) - 1
    return linked.select(by, number.cast("long").alias("link_no"), *names, *carried, "confidence")


def timing_delay(links: DataFrame, first: str, second: str, name: str = "delay") -> DataFrame:
    """Links with the second modality's time less the first's; null where one is absent."""
    return links.withColumn(name, F.col(f"t_{second}") - F.col(f"t_{first}"))


def duration_difference(links: DataFrame, first: str, second: str, name: str = "duration_difference") -> DataFrame:
    """Links with the first modality's duration (end_ - start_) less the second's."""
    duration = {m: F.col(f"end_{m}") - F.col(f"start_{m}") for m in (first, second)}
    return links.withColumn(name, duration[first] - duration[second])


def event_agreement(links: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Per recording: links with all of the modalities, by links with any; 0 where there are none."""
    there = [F.col(f"t_{m}").isNotNull() for m in modalities]
    every, some = there[0], there[0]
    for x in there[1:]:
        every, some = every & x, some | x
    n_all, n_any = F.sum(every.cast("long")), F.sum(some.cast("long"))
    return links.groupBy(BY).agg(n_all.alias("n_all"), n_any.alias("n_any"), F.coalesce(F.try_divide(n_all, n_any), F.lit(0.0)).alias("agreement"))


def timing_parameters(links: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Long rows (recording_id, link_no, name, value): delays of every pair of modalities."""
    pairs = [F.struct(F.lit(f"delay_{a}_{b}").alias("name"), (F.col(f"t_{b}") - F.col(f"t_{a}")).alias("value")) for a, b in combinations(sorted(modalities), 2)]
    return links.select(BY, "link_no", F.explode(F.array(*pairs)).alias("p")).select(BY, "link_no", "p.name", "p.value").where("value IS NOT NULL")


def match_events(detected: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """(recording_id, matched, extra, missed, f1): one-to-one pairs, the closest pairs first.  Pieces are counted apart and summed."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        d, r = np.sort(pdf.loc[pdf["detected"], "t"].to_numpy(float)), np.sort(pdf.loc[~pdf["detected"], "t"].to_numpy(float))
        # bounds a little wider than the tolerance; the difference itself decides
        slack = tolerance * (1 + 1e-9) + 1e-9 * np.abs(d)
        low, high = np.searchsorted(r, d - slack), np.searchsorted(r, d + slack, "right")
        near = sorted((abs(d[i] - r[j]), i, j) for i in range(len(d)) for j in range(low[i], high[i]) if abs(d[i] - r[j]) <= tolerance)
        did, dref = set(), set()
        for _, i, j in near:
            if i not in did and j not in dref:
                did.add(i)
                dref.add(j)
        return pd.DataFrame({BY: [pdf[BY].iloc[0]], "m": [len(did)], "d": [len(d)], "r": [len(r)]})

    both = detected.select(BY, "t", F.lit(True).alias("detected")).unionByName(reference.select(BY, "t", F.lit(False).alias("detected")))
    counts = in_pieces(both, tolerance).groupBy(BY, "piece").applyInPandas(pair, f"{BY} long, m long, d long, r long")
    m, d, r = F.sum("m"), F.sum("d"), F.sum("r")
    return counts.groupBy(BY).agg(m.alias("matched"), (d - m).alias("extra"), (r - m).alias("missed"), (2 * m / (d + r)).alias("f1"))
