"""Range joins without a nested loop: intervals are cut to buckets, and the join is on the bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_intervals(samples: DataFrame, intervals: DataFrame, start: str = "start_idx", end: str = "end_idx", at: str = "idx", by: str = "recording_id", bucket: float = 256, closed: bool = True) -> DataFrame:
    """Rows of ``samples`` joined to every interval of their recording that holds them.

    ``closed``: the end belongs to the interval.  Choose ``bucket`` near the usual
    length: an interval is repeated for each bucket it touches, a sample never.
    """
    low, high = (F.floor(F.col(c) / F.lit(bucket)).cast("long") for c in (start, end))
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, high))))
    placed = samples.withColumn("_bucket", F.floor(F.col(at) / F.lit(bucket)).cast("long"))
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return placed.join(cut, [by, "_bucket"]).where((F.col(at) >= F.col(start)) & upper).drop("_bucket")


#: Buckets of level k are 2**k units wide.
LEVELS = (-20, 62)


def _level(start: Column, end: Column) -> Column:
    """The least level whose buckets are as wide as the interval, so that it touches two of them at most."""
    length = end - start
    return F.when(length > 0, F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.ceil(F.log2(length))))).otherwise(F.lit(LEVELS[0])).cast("int")


def _bucket(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def overlapping(left: DataFrame, right: DataFrame, by: str = "recording_id", start: str = "start_time", end: str = "end_time", closed: bool = True) -> DataFrame:
    """Pairs of intervals of one recording that overlap: all columns of both, prefixed ``left_`` and ``right_``, and ``by``.

    Lengths may be as unequal as they like.  Each interval lives in the buckets of its own level, two at
    most, and visits, again two at most, those of each longer level that the other side has; the longer interval of
    a pair meets the shorter one in a bucket of its own level.  A pair is reported where the later of
    the two starts lies, hence once.  ``closed``: intervals that share an end point overlap.
    Intervals that end before they start, or with a null bound, overlap with nothing; a null ``by`` joins nothing.
    """
    sides = {"left": left, "right": right}
    at, to = {}, {}
    good = {}
    for name, side in sides.items():
        at[name], to[name] = F.col(f"{name}_{start}").cast("double"), F.col(f"{name}_{end}").cast("double")
        renamed = side.select(F.col(by).alias(by), *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c != by])
        good[name] = renamed.where(at[name] <= to[name]).withColumn(f"_{name}_level", _level(at[name], to[name]))
    # the levels that each side has are few, whatever the number of intervals
    levels = {name: sorted(r[0] for r in side.select(f"_{name}_level").distinct().collect()) for name, side in good.items()}

    def living(name: str) -> DataFrame:
        level = F.col(f"_{name}_level")
        return good[name].withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(_bucket(at[name], level), _bucket(to[name], level))))

    def visiting(name: str, other: str, strictly: bool) -> DataFrame:
        level = F.col(f"_{name}_level")
        longer = F.array(*[F.lit(k) for k in levels[other]]) if levels[other] else F.array().cast("array<int>")
        higher = F.filter(longer, lambda k: (k > level) if strictly else (k >= level))
        out = good[name].withColumn("_level", F.explode(higher))
        return out.withColumn("_bucket", F.explode(F.sequence(_bucket(at[name], F.col("_level")), _bucket(to[name], F.col("_level")))))

    def meet(long: str, short: str, strictly: bool) -> DataFrame:
        pairs = living(long).join(visiting(short, long, strictly), [by, "_level", "_bucket"])
        here = F.col("_bucket") == _bucket(F.greatest(at["left"], at["right"]), F.col("_level"))
        touch = (at["left"] <= to["right"]) & (at["right"] <= to["left"]) if closed else (at["left"] < to["right"]) & (at["right"] < to["left"])
        columns = [by, *[c for name in ("left", "right") for c in good[name].columns if c.startswith(f"{name}_")]]
        return pairs.where(here & touch).select(*columns)

    return meet("left", "right", False).unionByName(meet("right", "left", True))
