"""Recordings of one session on one clock: the clock dimension, and links of breaths through it.

Every file and channel has a ``recording_id`` of its own, so recordings of a session
meet only through the dimension ``clocks``: (session_id, recording_id, modality, channel,
start_time, sync_method), a row for each recording.  Events keep the time of their own
recording until they are placed; a recording that was never synchronized starts at 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pneumaspark.operators import linking

BY = "recording_id"
SESSION = "session_id"
CLOCKS = "session_id string, recording_id long, modality string, channel string, start_time double, sync_method string"
ANCHORS = {"start": "start_time", "extremum": "extremum_time", "end": "end_time"}
#: Rows of the dimension that are sent to every task, and no more.
FEW = 200_000


def clock_rows(recordings: DataFrame, modality: str, session: str | Column, start_time: float | Column = 0.0, sync_method: str | None = None) -> DataFrame:
    """The dimension's rows for one modality from any rows that name its recordings."""
    session = F.lit(session) if isinstance(session, str) else session
    start = start_time if isinstance(start_time, Column) else F.lit(float(start_time))
    channel = F.col("channel") if "channel" in recordings.columns else F.lit(None).cast("string")
    rows = recordings.select(session.cast("string").alias(SESSION), F.col(BY).cast("long").alias(BY), F.lit(modality).alias("modality"), channel.alias("channel"), start.alias("start_time"), F.lit(sync_method).cast("string").alias("sync_method"))
    return rows.distinct()


def moved(clocks: DataFrame, starts: Mapping[str, float], method: str = "manual_offset") -> DataFrame:
    """The dimension with new start times by modality; the others keep theirs."""
    if not starts:
        return clocks
    known = F.create_map(*[x for m, s in starts.items() for x in (F.lit(m), F.lit(float(s)))])
    new = F.try_element_at(known, F.col("modality"))
    return clocks.withColumns({"start_time": F.coalesce(new, F.col("start_time")), "sync_method": F.when(new.isNotNull(), F.lit(method)).otherwise(F.col("sync_method"))})


def on_shared_clock(events: DataFrame, clocks: DataFrame, columns: Sequence[str] = ("start_time", "extremum_time", "end_time")) -> DataFrame:
    """Events with ``session_id``, and with their times moved by their recording's start.

    An event whose recording has no row stays as it is, with a null session.
    """
    few = clocks.limit(FEW + 1).count() <= FEW
    own = clocks.select(F.col(BY).alias("_recording"), SESSION, F.col("start_time").alias("_start"))
    there = [c for c in columns if c in events.columns]
    placed = events.drop(SESSION).join(F.broadcast(own) if few else own, F.col(BY) == F.col("_recording"), "left")
    return placed.withColumns({c: F.col(c) + F.coalesce("_start", F.lit(0.0)) for c in there}).drop("_recording", "_start")


def estimate_offsets(reference: DataFrame, other: DataFrame, window: tuple[float, float], reference_fs: float, other_fs: float, by: str = SESSION, margin: float = 20.0, search: float = 30.0, **how) -> DataFrame:
    """(session_id, offset, correlation, reason): where each session's other recording begins on the reference's clock.

    Both sides are (session_id, idx, value) of one quantity, such as airway pressure; see ``offset.clock_offset``.
    What can't matter for the window is pruned before sessions are grouped, so a group holds the
    window, the margins and the search, whatever the recordings' lengths.  A session without an estimate has the reason.
    """
    from pneumaspark.operators.kernels import offset

    first = max(0, int((window[0] - margin) * reference_fs) - int(reference_fs))
    near = reference.where((F.col("idx") >= first) & (F.col("idx") <= int((window[1] + margin + 1) * reference_fs)))
    # beyond this its samples fall behind the margin for every offset that is searched
    pruned = other.where(F.col("idx") <= int((window[1] + margin + search + 1) * other_fs))
    kind = reference.schema[by].dataType.simpleString()

    def estimate(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found, r, reason = None, None, None
        try:
            if not len(a) or not len(b):
                raise ValueError("one of the recordings isn't there")
            a, b = a.sort_values("idx"), b.sort_values("idx")
            x, y = a["value"].to_numpy(float), b["value"].to_numpy(float)
            found, r = offset.clock_offset(x, reference_fs, y, other_fs, window, float(a["idx"].iloc[0]) / reference_fs, margin=margin, search=search, **how)
        except ValueError as e:
            reason = str(e)
        return pd.DataFrame({by: [key[0]], "offset": [found], "correlation": [r], "reason": [reason]})

    # the second side's key has a name of its own, as both may come from one table
    sides = [x.select(F.col(by).alias(name), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")) for name, x in ((by, near), ("_other", pruned))]
    return sides[0].groupBy(by).cogroup(sides[1].groupBy("_other")).applyInPandas(estimate, f"{by} {kind}, offset double, correlation double, reason string")


def session_breaths(lists: Mapping[str, DataFrame], clocks: DataFrame) -> DataFrame:
    """Breaths of all modalities as rows (session_id, recording_id, modality, event_id, t, start_time, extremum_time, end_time) on the shared clock.

    ``t`` is the extremum, or the middle where there is none; ``event_id`` numbers a recording's breaths by
    what they are, so it is the same on every run.
    """
    times = ["start_time", "extremum_time", "end_time"]
    out = []
    for modality, breaths in lists.items():
        own = breaths.select(F.col(BY).cast("long").alias(BY), *[F.col(c).cast("double").alias(c) if c in breaths.columns else F.lit(None).cast("double").alias(c) for c in times])
        placed = on_shared_clock(own, clocks.where(F.col("modality") == modality))
        t = F.coalesce("extremum_time", (F.col("start_time") + F.col("end_time")) / 2)
        out.append(placed.select(SESSION, BY, F.lit(modality).alias("modality"), F.xxhash64(BY, *times).alias("event_id"), t.alias("t"), *times))
    both = out[0]
    for rows in out[1:]:
        both = both.unionByName(rows)
    return both.where("t IS NOT NULL")


def link_sessions(lists: Mapping[str, DataFrame], clocks: DataFrame, tolerance: float = linking.DEFAULT_TOLERANCE) -> DataFrame:
    """Greedy links of each session's breaths, whatever files they come from.

    (session_id, link_no, and for each modality t_, event_id_, start_time_, extremum_time_ and end_time_, confidence).
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    return linking.link_greedy(session_breaths(lists, clocks), tuple(lists), tolerance, SESSION, ("event_id", "start_time", "extremum_time", "end_time"))


TIMINGS = ("session_id", "link_no", "name", "value", "unit", "method", "confidence")


def breath_timing(links: DataFrame, delay_pairs: Sequence[tuple[str, str]] | None = None, duration_pairs: Sequence[tuple[str, str]] | None = None, anchor: str = "start") -> DataFrame:
    """Long rows of delays, differences of durations and agreement (see ``TIMINGS``).

    A delay is the second modality's anchor (start, extremum or end) less the first's; a difference the first's
    duration less the second's.  Both need both breaths.  Agreement, a row for each session and delay
    pair, is the share of links with both among those with either; it has no link.  Pairs that aren't
    given are all pairs of the links' modalities, in order of name.
    """
    if anchor not in ANCHORS:
        raise ValueError(f"anchor {anchor!r} must be one of {sorted(ANCHORS)}")
    names = sorted(c.removeprefix("t_") for c in links.columns if c.startswith("t_"))
    every = list(combinations(names, 2))
    delay_pairs = every if delay_pairs is None else list(delay_pairs)
    duration_pairs = every if duration_pairs is None else list(duration_pairs)
    unknown = {m for pair in [*delay_pairs, *duration_pairs] for m in pair} - set(names)
    none = F.lit(None).cast("double")
    at = {m: none if m in unknown else F.col(f"{ANCHORS[anchor]}_{m}") for m in {*names, *unknown}}
    length = {m: none if m in unknown else F.col(f"end_time_{m}") - F.col(f"start_time_{m}") for m in {*names, *unknown}}
    there = {m: F.lit(False) if m in unknown else F.col(f"t_{m}").isNotNull() for m in {*names, *unknown}}

    def row(name: str, value: Column, method: str) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("s").alias("unit"), F.lit(method).alias("method"))

    rows = [row(f"{a}_to_{b}_delay", at[b] - at[a], f"timing_delay[{anchor}]") for a, b in delay_pairs]
    rows += [row(f"{a}_{b}_duration_difference", length[a] - length[b], "breath_duration_difference") for a, b in duration_pairs]
    agreement = [
        F.struct(F.lit(f"{a}_{b}_event_agreement").alias("name"), F.count_if(there[a] & there[b]).alias("both"), F.count_if(there[a] | there[b]).alias("either")) for a, b in delay_pairs
    ]
    out = []
    if rows:
        per_link = links.select(SESSION, "link_no", "confidence", F.explode(F.array(*rows)).alias("r"))
        out.append(per_link.select(SESSION, "link_no", "r.name", "r.value", "r.unit", "r.method", "confidence").where("value IS NOT NULL"))
    if agreement:
        per_session = links.groupBy(SESSION).agg(F.array(*agreement).alias("pairs")).select(SESSION, F.explode("pairs").alias("p")).where("p.either > 0")
        out.append(per_session.select(SESSION, F.lit(None).cast("long").alias("link_no"), "p.name", (F.col("p.both") / F.col("p.either")).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("event_agreement").alias("method"), none.alias("confidence")))
    if not out:
        return links.limit(0).select(SESSION, "link_no", *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("value", "double"), ("unit", "string"), ("method", "string"), ("confidence", "double"))])
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
