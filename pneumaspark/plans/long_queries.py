"""Queries on long recordings, intervals of unequal lengths, clocks that differ, columns and gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pneumaspark import archive
from pneumaspark.operators import channels, clocks, pixels, rangejoin, windows
from pneumaspark.operators.kernels import iir
from pneumaspark.plans.catalog import FRAMES, SAMPLES, WHOLE, samples, with_
from pneumaspark.session import shared_dir, table
from pneumaspark.sources.bindings import embedding_frames, region_prices

FS = 2048
#: The defaults of a muscle baseline: 7.5 s of samples, every 0.2 s.
WINDOW, STEP = int(7.5 * FS), int(0.2 * FS)


def moving_baseline_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of each step of a recording at 2048 Hz with the default window."""
    based = windows.moving_baseline(region_prices(spark, sf_dir), WINDOW, STEP)
    return based.where(F.col("idx") % STEP == 0).select("recording_id", F.expr(f"idx div {STEP}").alias("step_no"), F.round("baseline", 4).alias("baseline"))


def rolling_rms_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of a quarter of a second, by chunk, at each step."""
    length = FS // 4
    enveloped = windows.rolling_envelope(region_prices(spark, sf_dir), length, "rms")
    return enveloped.where(F.col("idx") % STEP == 0).select("recording_id", F.expr(f"idx div {STEP}").alias("step_no"), F.round("envelope", 2).alias("envelope"))


def _intervals(spark: SparkSession, sf_dir: str, kind: str, base: int, powers: int) -> DataFrame:
    length = F.pow(F.lit(float(base)), F.col("idx") % powers)
    return samples(spark, sf_dir).where(F.col("event_type") == kind).select("recording_id", "idx", F.col("t").alias("start_time"), (F.col("t") + length).alias("end_time"))


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's views and clicks that last from a second to days and overlap, with the time they share."""
    pairs = rangejoin.overlapping(_intervals(spark, sf_dir, "view", 2, 21), _intervals(spark, sf_dir, "click", 3, 13))
    shared = F.least("left_end_time", "right_end_time") - F.greatest("left_start_time", "right_start_time")
    return pairs.select("recording_id", F.col("left_idx").alias("left_idx"), F.col("right_idx").alias("right_idx"), F.round(shared, 4).alias("shared"))


PRESSURE_FS = 20.0


def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a second device began, found from the pressure that both have recorded; it was started 3 s and 0.35 s a region later."""
    reference = region_prices(spark, sf_dir)
    late = 60 + 7 * F.col("recording_id")
    other = reference.where(F.col("idx") >= late).withColumn("idx", F.col("idx") - late)
    found = clocks.estimate_offsets(reference, other, (10.0, 30.0), PRESSURE_FS, PRESSURE_FS, "recording_id")
    return found.select("recording_id", F.round("offset", 2).alias("offset"), (F.col("correlation") > 0.999).alias("alike"))


#: Labels of columns, with the channel that each names and its tag.
LABELS = (
    ("Paw", "airway_pressure", None), ("Airway pressure (pod)", "airway_pressure", "pod"), ("flow_(draeger)", "flow", None), ("Volume", "volume", None), ("ch7", None, None), ("Pes", "esophageal_pressure", None),
    ("VT", "tidal_volume", None), ("Pressure (raw)", "airway_pressure", None), ("Airway Flow", "flow", None), ("noise (pod)", None, "pod"), ("PL", "transpulmonary_pressure", None), ("volume (timpel)", "volume", None),
)
_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def resolved_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a recording whose lines are its columns: which of them are pressure, flow and volume."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINES.split(", "))) - 1
    label = F.get(F.array(*[F.lit(x[0]) for x in LABELS]), (F.col("l_partkey") % len(LABELS)).cast("int"))
    unit = F.get(F.array(F.lit("mbar"), F.lit(" "), F.lit(None).cast("string")), (F.col("l_suppkey") % 3).cast("int"))
    heads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), number.alias("number"), label.alias("label"), unit.alias("unit"))
    return channels.resolve_channels(heads)


#: What isn't measured of three pixels: nothing of the first, a few frames of each thirty of the second, every eighth of the third.
GAP_PIXELS = 3


def frames_with_gaps_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing samples of each pixel after a low-pass that keeps gaps; runs too short for it are missing, too."""
    k, z = F.col("frame_idx"), F.col("pixels")
    gone = F.when(k >= 0, F.array(F.lit(True), k % 30 < 4, k % 8 == 0))
    holed = F.concat(F.transform(F.slice(z, 1, GAP_PIXELS), lambda x, i: F.when(~F.get(gone, i), x)), F.slice(z, GAP_PIXELS + 1, 64))
    frames = embedding_frames(spark, sf_dir).withColumn("pixels", holed)
    filtered = pixels.filter_preserving_gaps(frames, "lowpass", 1.0, 20.0, order=2, strict=False, length=256)
    rows = filtered.select("recording_id", F.posexplode("pixels").alias("pixel", "z"))
    return rows.groupBy("recording_id", "pixel").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("z").isNull()).alias("n_missing"))


#: Frames by which a pixel may come before or after the whole.
MOST_LAG = 3


def pixel_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many frames each pixel comes after the sum of all, and how alike they are then."""
    found = pixels.pixel_lags(embedding_frames(spark, sf_dir), MOST_LAG, length=64)
    return found.select("recording_id", "pixel", "lag", F.round("correlation", 6).alias("correlation"))


def archived_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 8 x 8 and scalars of all labels, written as rows and arrays and read back: how many, and their sums."""
    frames = embedding_frames(spark, sf_dir)
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("pixels"), i * 8 + 1, 8))
    name = F.concat(F.lit("label_"), F.col("recording_id").cast("string"))
    arrays = frames.select(name.alias("name"), "frame_idx", F.lit(None).cast("double").alias("value"), grid.alias("values"))
    scalars = frames.select(F.lit("first_pixel").alias("name"), "frame_idx", F.get("pixels", F.lit(0)).alias("value"), F.lit(None).cast("array<array<double>>").alias("values"))
    out = archive.write(arrays.unionByName(scalars), f"{shared_dir(spark)}/results-{uuid.uuid4().hex}")
    back = archive.read(spark, out, ("values",), ("values",))
    total = F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("values").alias("n_arrays"), F.round(F.sum(F.coalesce("value", total)), 4).alias("total"), F.max(F.size(F.get("values", F.lit(7)))).alias("width"))


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


_SHORTEST = iir.edge(iir.butterworth(2, 1.0, 20.0, "lowpass")) + 1

_REGION = """prices AS (
  SELECT CAST(n_regionkey AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, l_extendedprice AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
_PIECES = "SELECT recording_id, idx AS k, t AS start_time, t + pow(CAST({base} AS DOUBLE), idx % {powers}) AS end_time FROM samples WHERE event_type = '{kind}'"

QUERIES = {f.__name__: f for f in (moving_baseline_2048, rolling_rms_2048, interval_overlaps, clock_offsets, resolved_channels, frames_with_gaps_filtered, pixel_lags, archived_results)}
SQL: dict[str, str] = {
    "moving_baseline_2048": with_(_REGION, f"steps AS (SELECT recording_id, idx // {STEP} AS step_no, idx AS at FROM prices WHERE idx % {STEP} = 0)")
    + f"""SELECT s.recording_id, s.step_no, round(quantile_cont(p.value, 0.33), 4) AS baseline FROM steps s
JOIN prices p ON p.recording_id = s.recording_id AND p.idx BETWEEN s.at - {WINDOW // 2} AND s.at + {WINDOW // 2} GROUP BY s.recording_id, s.step_no""",
    "rolling_rms_2048": with_(_REGION)
    + f"""SELECT recording_id, idx // {STEP} AS step_no, round(envelope, 2) AS envelope FROM (SELECT recording_id, idx, sqrt(avg(value * value) OVER (
  PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {FS // 8} PRECEDING AND {FS // 8 - 1} FOLLOWING)) AS envelope FROM prices) WHERE idx % {STEP} = 0""",
    "interval_overlaps": with_(SAMPLES, f"a AS ({_PIECES.format(base=2, powers=21, kind='view')})", f"b AS ({_PIECES.format(base=3, powers=13, kind='click')})")
    + """SELECT a.recording_id, a.k AS left_idx, b.k AS right_idx, round(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time), 4) AS shared
FROM a JOIN b ON b.recording_id = a.recording_id AND a.start_time <= b.end_time AND b.start_time <= a.end_time""",
    "clock_offsets": with_(_REGION) + "SELECT recording_id, round((60 + 7 * recording_id) / 20.0, 2) AS offset, true AS alike FROM (SELECT DISTINCT recording_id FROM prices)",
    "resolved_channels": with_(
        "known(i, label, channel, tag) AS (VALUES " + ", ".join(f"({i}, '{label}', {_quoted(c)}, {_quoted(t)})" for i, (label, c, t) in enumerate(LABELS)) + ")",
        f"""heads AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS INTEGER) AS number, label, channel, tag, CASE l_suppkey % 3 WHEN 0 THEN 'mbar' END AS unit
  FROM lineitem JOIN known ON i = l_partkey % {len(LABELS)})""",
        "asked(rank, channel, category, usual_unit) AS (VALUES (0, 'airway_pressure', 'airway_pressure', 'cmH2O'), (1, 'flow', 'airflow', 'L/min'), (2, 'volume', 'volume', 'L'))",
        "files AS (SELECT path, bool_or(channel IS NOT NULL) AS named FROM heads GROUP BY path)",
        """found AS (SELECT h.path, a.rank, a.channel, category, usual_unit, label, tag, unit, number FROM heads h JOIN asked a USING (channel)
  UNION ALL SELECT f.path, rank, a.channel, category, usual_unit, label, tag, unit, CAST(rank AS INTEGER) FROM files f CROSS JOIN asked a LEFT JOIN heads h ON h.path = f.path AND h.number = a.rank WHERE NOT named)""",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY path, rank ORDER BY number) AS nth FROM found)",
        "keyed AS (SELECT *, CASE WHEN nth = 1 THEN channel ELSE channel || '__' || coalesce(tag, 'col' || number) END AS k FROM ranked)",
        "counted AS (SELECT *, row_number() OVER (PARTITION BY path, k ORDER BY rank, nth) AS taken FROM keyed)",
    )
    + "SELECT path, CASE WHEN taken = 1 THEN k ELSE k || taken END AS key, channel, category, tag AS origin, label, coalesce(unit, usual_unit) AS unit, number, nth = 1 AS is_primary FROM counted",
    "frames_with_gaps_filtered": with_(
        FRAMES,
        "z AS (SELECT recording_id, frame_idx AS k, u.p AS pixel, CASE u.p WHEN 0 THEN true WHEN 1 THEN frame_idx % 30 < 4 WHEN 2 THEN frame_idx % 8 = 0 ELSE false END AS gone FROM frames, unnest(range(64)) AS u(p))",
        "runs AS (SELECT *, sum(CAST(gone AS INT)) OVER (PARTITION BY recording_id, pixel ORDER BY k) AS run FROM z)",
        "sized AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY recording_id, pixel, run) AS size FROM runs)",
    )
    + f"SELECT recording_id, CAST(pixel AS INTEGER) AS pixel, count(*) AS n_frames, count(*) FILTER (gone OR size < {_SHORTEST}) AS n_missing FROM sized GROUP BY recording_id, pixel",
    "pixel_lags": with_(
        FRAMES,
        WHOLE,
        "z AS (SELECT recording_id, frame_idx AS idx, CAST(u.i - 1 AS INTEGER) AS pixel, pixels[u.i] AS z FROM frames, (SELECT unnest(range(1, 65)) AS i) u)",
        f"r AS (SELECT w.recording_id, pixel, CAST(l.lag AS INTEGER) AS lag, corr(w.value, z.z) AS r FROM whole w, range({-MOST_LAG}, {MOST_LAG + 1}) l(lag) JOIN z ON z.recording_id = w.recording_id AND z.idx = w.idx + l.lag GROUP BY ALL)",
    )
    + "SELECT recording_id, pixel, lag, round(r, 6) AS correlation FROM r QUALIFY row_number() OVER (PARTITION BY recording_id, pixel ORDER BY r DESC, abs(lag), lag) = 1",
    "archived_results": with_(FRAMES)
    + """SELECT 'label_' || recording_id AS name, count(*) AS n, count(*) AS n_arrays, round(sum(list_sum(pixels)), 4) AS total, 8 AS width FROM frames GROUP BY recording_id
UNION ALL SELECT 'first_pixel', count(*), 0, round(sum(pixels[1]), 4), NULL FROM frames""",
}
