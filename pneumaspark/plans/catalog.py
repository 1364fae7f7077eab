"""Registered signal queries: each applies an operator to whole tables.

``register`` takes the query's name, its DuckDB twin (None where SQL can't state
the operator) and the function.  Floats are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pneumaspark.functions import vocabulary
from pneumaspark.operators import filters, heartbeats, linking, metrics, peaks, pixels, quality, slicing, validation, windows
from pneumaspark.session import table
from pneumaspark.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---- DuckDB building blocks

SAMPLES = """samples AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value, event_type FROM events)"""
AVERAGE = """averaged AS (
  SELECT recording_id, idx, t, value, (avg(value) OVER w * count(*) OVER w
    + greatest(2 - idx, 0) * first_value(value) OVER f + greatest(idx + 2 - (count(*) OVER p - 1), 0) * last_value(value) OVER f) / 5 AS average
  FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), p AS (PARTITION BY recording_id),
    f AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
EXTREMA = """extrema AS (
  SELECT recording_id, idx, t, value, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w, false) AS is_peak,
         coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false) AS is_valley
  FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY idx))"""
BREATHS = """turns AS (
  SELECT *, min(CASE WHEN is_peak THEN idx END) OVER w AS peak_idx, min(CASE WHEN is_valley THEN idx END) OVER w AS end_idx
  FROM extrema WHERE is_peak OR is_valley
  WINDOW w AS (PARTITION BY recording_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
breaths AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY idx) - 1 AS breath_no, idx AS start_idx, peak_idx, end_idx
  FROM turns WHERE is_valley AND peak_idx < end_idx)"""
BASE = """anchors AS (
  SELECT recording_id, idx AS anchor, quantile_cont(value, 0.33) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS baseline FROM samples),
based AS (SELECT s.*, a.baseline FROM samples s JOIN anchors a ON a.recording_id = s.recording_id AND a.anchor = s.idx - s.idx % 5)"""
FRAMES = """frames AS (
  SELECT CAST(label AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, CAST(embedding AS DOUBLE[]) AS pixels FROM embeddings)"""
WHOLE = "whole AS (SELECT recording_id, frame_idx AS idx, list_sum(pixels) AS value FROM frames)"
FRAME_BREATHS = EXTREMA.replace("idx, t, value", "idx, value").replace("FROM samples", "FROM whole") + ", " + BREATHS
PIXELS = "z AS (SELECT recording_id, frame_idx AS idx, CAST(u.i - 1 AS INTEGER) AS pixel, pixels[u.i] AS z FROM frames, (SELECT unnest(range(1, 65)) AS i) u)"
TIV = """tiv AS (
  SELECT b.recording_id, b.breath_no, m.pixel, m.z - s.z AS tiv FROM breaths b JOIN z m ON m.recording_id = b.recording_id AND m.idx = b.peak_idx
  JOIN z s ON s.recording_id = b.recording_id AND s.idx = b.start_idx AND s.pixel = m.pixel)"""
TIVMASK = """tmean AS (SELECT recording_id, pixel, avg(tiv) AS mean FROM tiv GROUP BY ALL),
tmask AS (SELECT recording_id, pixel, mean, mean >= 0.15 * max(mean) OVER (PARTITION BY recording_id) AS included FROM tmean)"""
MODALITIES = "('view', 'eit'), ('click', 'emg'), ('purchase', 'ventilator')"
EVENTS = f"""modal AS (SELECT recording_id, m.modality, idx AS event_id, t FROM samples JOIN (VALUES {MODALITIES}) m(event_type, modality) USING (event_type)),
eit AS (SELECT recording_id, t FROM modal WHERE modality = 'eit'), emg AS (SELECT recording_id, t FROM modal WHERE modality = 'emg')"""


def nearest_sql(name: str, left: str, right: str) -> str:
    return f"""{name} AS (
  SELECT l.recording_id, l.t, (SELECT r.t FROM {right} r WHERE r.recording_id = l.recording_id ORDER BY abs(r.t - l.t), r.t LIMIT 1) AS nearest FROM {left} l)"""


MUTUAL = (
    nearest_sql("near_a", "eit", "emg")
    + ", "
    + nearest_sql("near_b", "emg", "eit")
    + f""", mutual AS (
  SELECT a.recording_id, a.t AS left_t, b.t AS right_t, greatest(0, 1 - abs(a.t - b.t) / 43200) AS confidence
  FROM near_a a JOIN near_b b ON b.recording_id = a.recording_id AND a.nearest = b.t AND b.nearest = a.t WHERE abs(a.t - b.t) <= 43200)"""
)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- Spark building blocks

TOLERANCE = 43200.0
MODALITY = {"view": "eit", "click": "emg", "purchase": "ventilator"}
#: Moves values with few decimals off the middle between two rounded ones, on both sides.
NUDGE = 3.3e-9
OFFSETS = {"eit": 0.0, "emg": 5.0, "ventilator": -2.0}


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded_share(shares: DataFrame) -> DataFrame:
    """Percentages to four decimals.  Sums of few decimals often give a share in the middle of two such; the last bit, which the order of a sum decides, doesn't."""
    return shares.select("recording_id", "breath_no", F.round(F.col("percentage") + NUDGE, 4).alias("percentage"), "passed")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return bindings.event_samples(spark, d)


def breaths(spark: SparkSession, d: str) -> DataFrame:
    return peaks.valley_peak_valley(peaks.strict_extrema(samples(spark, d)))


def based(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_baseline(samples(spark, d), 15, 5, 33.0)


def averaged(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_average(samples(spark, d), 5)


def peak_rows(spark: SparkSession, d: str) -> DataFrame:
    return peaks.strict_extrema(samples(spark, d)).where("is_peak").select("recording_id", "idx")


def modal(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in MODALITY.items() for x in kv])
    return samples(spark, d).select("recording_id", F.try_element_at(known, F.col("event_type")).alias("modality"), F.col("idx").alias("event_id"), "t").where("modality IS NOT NULL")


def modality(spark: SparkSession, d: str, name: str) -> DataFrame:
    return modal(spark, d).where(F.col("modality") == name).select("recording_id", "t")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return bindings.embedding_frames(spark, d)


def frame_breaths(spark: SparkSession, d: str) -> DataFrame:
    return peaks.valley_peak_valley(peaks.strict_extrema(pixels.global_impedance(frames(spark, d))))


def packed(spark: SparkSession, d: str) -> DataFrame:
    return bindings.pack(bindings.price_samples(spark, d))


def packed_events(spark: SparkSession, d: str) -> DataFrame:
    return bindings.pack(samples(spark, d))


def summary(signals: DataFrame, name: str = "values") -> DataFrame:
    """Numbers that describe each recording's array, rounded."""
    v = F.col(name)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return signals.select("recording_id", F.size(v).cast("long").alias("n"), F.round(total / F.size(v), 4).alias("mean"), F.round(F.sqrt(square / F.size(v)), 4).alias("rms"))


def summary_of_samples(rows: DataFrame) -> DataFrame:
    """The same numbers of recordings that are rows of samples."""
    n, v = F.count(F.lit(1)), F.col("value")
    return rows.groupBy("recording_id").agg(n.alias("n"), F.round(F.sum(v) / n, 4).alias("mean"), F.round(F.sqrt(F.sum(v * v) / n), 4).alias("rms"))


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


# ---- windows

for _name, _method, _expr in (
    ("rolling_rms", "rms", "sqrt(avg(value * value) OVER w)"),
    ("rolling_arv", "arv", "avg(abs(value)) OVER w"),
    ("rolling_median_abs", "median", "quantile_cont(abs(value), 0.5) OVER w"),
):
    register(
        _name,
        with_(SAMPLES) + f"SELECT recording_id, idx, round({_expr}, 6) AS envelope FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    )(lambda s, d, m=_method: windows.rolling_envelope(samples(s, d), 5, m).select("recording_id", "idx", r6("envelope", "envelope")))

T4 = 2.7764451051977934
_SEM = "stddev_samp({x}) OVER w / sqrt(nullif(count(value) OVER w - 1, 0))"
_FIVE = "WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
register(
    "rolling_rms_ci",
    with_(SAMPLES)
    + f"""SELECT recording_id, idx, round(CASE WHEN m - {T4} * e >= 0 THEN sqrt(m - {T4} * e) END, 4) AS low, round(sqrt(m + {T4} * e), 4) AS high
FROM (SELECT recording_id, idx, avg(value * value) OVER w AS m, {_SEM.format(x="value * value")} AS e FROM samples {_FIVE})""",
)(lambda s, d: windows.rolling_ci(samples(s, d), 5, "rms").select("recording_id", "idx", F.round("low", 4).alias("low"), F.round("high", 4).alias("high")))
register(
    "rolling_arv_ci",
    with_(SAMPLES)
    + f"""SELECT recording_id, idx, round(m - {T4} * e, 4) AS low, round(m + {T4} * e, 4) AS high
FROM (SELECT recording_id, idx, avg(abs(value)) OVER w AS m, {_SEM.format(x="value")} AS e FROM samples {_FIVE})""",
)(lambda s, d: windows.rolling_ci(samples(s, d), 5, "arv").select("recording_id", "idx", F.round("low", 4).alias("low"), F.round("high", 4).alias("high")))
register("moving_average_edge", with_(SAMPLES, AVERAGE) + "SELECT recording_id, idx, round(average, 6) AS average FROM averaged")(
    lambda s, d: averaged(s, d).select("recording_id", "idx", r6("average", "average"))
)
_B = windows.blackman(7)
_TERMS = " + ".join(
    f"({w!r}) * " + ("value" if k == 3 else f"coalesce(lag(value, {3 - k}) OVER w, first_value(value) OVER f)" if k < 3 else f"coalesce(lead(value, {k - 3}) OVER w, last_value(value) OVER f)")
    for k, w in enumerate(_B)
)
register(
    "moving_average_blackman",
    with_(SAMPLES)
    + f"""SELECT recording_id, idx, round({_TERMS}, 6) AS average FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY idx),
f AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)(lambda s, d: windows.moving_average(samples(s, d), 7, windows.blackman(7)).select("recording_id", "idx", r6("average", "average")))
register(
    "running_smoother",
    with_(SAMPLES)
    + """SELECT p.recording_id, CAST(u.i AS BIGINT) AS idx, round(CASE WHEN u.i > n - n // 10 THEN 0 ELSE list_avg(list_transform(v[u.i + 1 : u.i + n // 10], lambda x: abs(x))) END, 6) AS smoothed
FROM (SELECT recording_id, list(value ORDER BY idx) AS v, count(*) AS n FROM samples GROUP BY 1) p, unnest(range(n)) AS u(i) WHERE n >= 10""",
)(lambda s, d: bindings.unpack(windows.running_smoother(packed_events(s, d)), "smoothed", "smoothed").select("recording_id", "idx", r6("smoothed", "smoothed")))
register(
    "naive_rolling_rms",
    with_(SAMPLES)
    + """SELECT recording_id, idx, round(rms, 6) AS rms FROM (SELECT recording_id, idx, sqrt(avg(value * value) OVER w) AS rms, count(*) OVER w AS n FROM samples
WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE n = 5""",
)(lambda s, d: windows.naive_rolling_rms(samples(s, d), 5).select("recording_id", "idx", r6("rms", "rms")))
register("moving_baseline", with_(SAMPLES, BASE) + "SELECT recording_id, idx, round(baseline, 6) AS baseline FROM based")(
    lambda s, d: based(s, d).select("recording_id", "idx", r6("baseline", "baseline"))
)
register(
    "slopesum_baseline",
    with_(
        SAMPLES,
        "d AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY recording_id ORDER BY idx)), 0) AS s FROM samples)",
        "e AS (SELECT *, sum(s) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ss FROM d)",
        "q AS (SELECT *, CASE WHEN ss <= quantile_cont(ss, 0.25) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) THEN value END AS quiet FROM e)",
        "h AS (SELECT recording_id, idx, coalesce(quantile_cont(quiet, 0.33) OVER w, quantile_cont(value, 0.33) OVER w) AS held FROM q WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))",
    )
    + "SELECT q.recording_id, q.idx, round(h.held, 4) AS baseline FROM q JOIN h ON h.recording_id = q.recording_id AND h.idx = q.idx - q.idx % 5",
)(lambda s, d: windows.slopesum_baseline(samples(s, d), 15, 5, 5, 9).select("recording_id", "idx", F.round("baseline", 4).alias("baseline")))
register(
    "local_extrema_flags",
    with_(SAMPLES)
    + """SELECT recording_id, idx, CASE WHEN a > 0 AND b <= 0 THEN 1 WHEN a < 0 AND b >= 0 THEN -1 ELSE 0 END AS flag
FROM (SELECT recording_id, idx, value - lag(value) OVER w AS a, lead(value) OVER w - value AS b FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY idx))""",
)(lambda s, d: windows.local_extrema_flags(samples(s, d)).select("recording_id", "idx", "flag"))

# ---- peaks and crossings

CROSSINGS = """crossings AS (
  SELECT recording_id, idx FROM (SELECT recording_id, idx, sign(value - average) AS s, lead(sign(value - average)) OVER (PARTITION BY recording_id ORDER BY idx) AS n FROM averaged)
  WHERE n IS NOT NULL AND n <> s)"""
register("baseline_crossings", with_(SAMPLES, AVERAGE, CROSSINGS) + "SELECT recording_id, idx FROM crossings")(
    lambda s, d: peaks.baseline_crossings(averaged(s, d), "average")
)
register("valley_peak_valley", with_(SAMPLES, EXTREMA, BREATHS) + "SELECT recording_id, breath_no, start_idx, peak_idx, end_idx FROM breaths")(breaths)
register(
    "onoff_baseline_crossing",
    with_(SAMPLES, AVERAGE, CROSSINGS, EXTREMA)[:-1]
    + """,
near AS (SELECT p.recording_id, p.idx AS peak_idx, l.last_idx,
  (SELECT max(c.idx) FROM crossings c WHERE c.recording_id = p.recording_id AND c.idx < p.idx) AS b,
  (SELECT min(c.idx) FROM crossings c WHERE c.recording_id = p.recording_id AND c.idx >= p.idx) AS a,
  (SELECT min(c.idx) FROM crossings c WHERE c.recording_id = p.recording_id AND c.idx > p.idx) AS beyond
FROM extrema p JOIN (SELECT recording_id, max(idx) AS last_idx FROM samples GROUP BY 1) l ON l.recording_id = p.recording_id WHERE p.is_peak),
placed AS (SELECT recording_id, peak_idx, coalesce(b, 0) AS start_idx, coalesce(CASE WHEN b IS NULL THEN beyond ELSE a END, last_idx) AS end_idx,
  row_number() OVER (PARTITION BY recording_id ORDER BY peak_idx) AS k FROM near)
SELECT *, start_valid AND end_valid AS valid FROM (SELECT q.recording_id, q.peak_idx, q.start_idx, q.end_idx,
  NOT coalesce(q.start_idx <= y.end_idx AND y.end_idx <= q.peak_idx AND q.peak_idx - q.start_idx > y.end_idx - y.peak_idx, false) AS start_valid,
  NOT coalesce(q.end_idx > z.peak_idx OR (z.start_idx <= q.end_idx AND z.peak_idx - z.start_idx <= q.end_idx - q.peak_idx), false) AS end_valid
FROM placed q LEFT JOIN placed y ON y.recording_id = q.recording_id AND y.k = q.k - 1 LEFT JOIN placed z ON z.recording_id = q.recording_id AND z.k = q.k + 1)""",
)(lambda s, d: peaks.onoff_from_crossings(peaks.baseline_crossings(averaged(s, d), "average"), peak_rows(s, d), samples(s, d)))
register(
    "remove_duplicate_extrema",
    with_(
        SAMPLES,
        EXTREMA,
        "k AS (SELECT *, CASE WHEN is_peak THEN 1 ELSE -1 END AS kind FROM extrema WHERE is_peak OR is_valley)",
        "g AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY idx) - row_number() OVER (PARTITION BY recording_id, kind ORDER BY idx) AS run FROM k)",
    )
    + "SELECT recording_id, idx, kind FROM g QUALIFY row_number() OVER (PARTITION BY recording_id, kind, run ORDER BY value * kind DESC, idx) = 1",
)(lambda s, d: peaks.reduce_runs(peaks.strict_extrema(samples(s, d))).select("recording_id", "idx", "kind"))
register(
    "normalize_breaths",
    with_(SAMPLES, EXTREMA)
    + """SELECT p.recording_id, p.idx, greatest(p.idx / 1.0 - 0.25, 0) AS start_time, p.idx / 1.0 AS extremum_time, least(p.idx / 1.0 + 0.25, n.n / 1.0) AS end_time
FROM extrema p JOIN (SELECT recording_id, CAST(count(*) AS DOUBLE) AS n FROM samples GROUP BY 1) n ON n.recording_id = p.recording_id WHERE is_peak""".replace("p.idx / 1.0", "CAST(p.idx AS DOUBLE)"),
)(lambda s, d: peaks.normalize_breaths(peak_rows(s, d), samples(s, d), 1.0))
register("detect_peaks_prominence")(lambda s, d: filters.detect_peaks(packed_events(s, d), prominence=50.0, width=1, distance=2))
register("merge_close_peaks")(lambda s, d: filters.merge_close_peaks(packed_events(s, d), 3))
register("emg_breath_peaks")(lambda s, d: filters.detect_breaths(packed_events(s, d), "emg"))
register("volume_breath_peaks")(lambda s, d: filters.detect_breaths(packed_events(s, d), "volume", width=1))
register("occluded_breaths")(lambda s, d: filters.detect_breaths(packed(s, d), "occluded", fs=10.0, peep=50000.0, factor=0.2))
register("pressure_dips")(lambda s, d: filters.detect_breaths(packed(s, d), "dips", fs=10.0))
register("onoff_slope")(lambda s, d: filters.onoff_slope(packed_events(s, d), 1.0, 2, 50.0))

# ---- per-breath metrics

INSIDE = "samples s JOIN breaths b ON b.recording_id = s.recording_id AND s.idx BETWEEN b.start_idx AND b.end_idx"
register(
    "time_to_peak",
    with_(SAMPLES, EXTREMA, BREATHS)
    + f"""SELECT recording_id, breath_no, idx - start_idx AS samples, round((idx - start_idx) / (end_idx - start_idx), 6) AS fraction
FROM (SELECT s.recording_id, s.idx, b.breath_no, b.start_idx, b.end_idx, row_number() OVER (PARTITION BY b.recording_id, b.breath_no ORDER BY s.value DESC, s.idx) AS r FROM {INSIDE} AND s.idx < b.end_idx) WHERE r = 1""",
)(lambda s, d: metrics.time_to_peak(samples(s, d), breaths(s, d)).select("recording_id", "breath_no", "samples", r6("fraction", "fraction")))
register(
    "pseudo_slope",
    with_(SAMPLES, EXTREMA, BREATHS)
    + f"""SELECT recording_id, breath_no, round(v / nullif(idx - start_idx, 0), 6) AS slope
FROM (SELECT s.recording_id, s.idx, abs(s.value) AS v, b.breath_no, b.start_idx, row_number() OVER (PARTITION BY b.recording_id, b.breath_no ORDER BY abs(s.value) DESC, s.idx) AS r FROM {INSIDE} AND s.idx < b.end_idx) WHERE r = 1""",
)(lambda s, d: metrics.pseudo_slope(samples(s, d), breaths(s, d)).select("recording_id", "breath_no", r6("slope", "slope")))
register(
    "amplitude_at_peaks",
    with_(SAMPLES, EXTREMA, BREATHS, BASE) + "SELECT b.recording_id, b.breath_no, round(s.value - s.baseline, 6) AS amplitude FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx",
)(lambda s, d: metrics.amplitude_at_peaks(based(s, d), breaths(s, d), "baseline").select("recording_id", "breath_no", r6("amplitude", "amplitude")))
PRODUCT = """step AS (SELECT recording_id, idx, (value - baseline + lag(value - baseline) OVER (PARTITION BY recording_id ORDER BY idx)) / 2 AS area FROM based),
product AS (SELECT b.recording_id, b.breath_no, abs(sum(s.area)) AS time_product FROM breaths b JOIN step s ON s.recording_id = b.recording_id AND s.idx > b.start_idx AND s.idx <= b.end_idx GROUP BY 1, 2)"""
register("time_product", with_(SAMPLES, EXTREMA, BREATHS, BASE, PRODUCT) + "SELECT recording_id, breath_no, round(time_product, 6) AS time_product FROM product")(
    lambda s, d: metrics.time_product(based(s, d), breaths(s, d), 1.0, "baseline").select("recording_id", "breath_no", r6("time_product", "time_product"))
)
AUB = """up AS (SELECT b.recording_id, b.breath_no, avg(CASE WHEN s.value >= s.baseline THEN 1.0 ELSE 0.0 END) >= 0.5 AS up
  FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx > b.start_idx AND s.idx <= b.end_idx GROUP BY 1, 2),
lasts AS (SELECT recording_id, max(idx) AS last_idx FROM samples GROUP BY 1),
lev AS (SELECT b.recording_id, b.breath_no, min(s.value) AS low, max(s.value) AS high FROM breaths b JOIN lasts l ON l.recording_id = b.recording_id
  JOIN samples s ON s.recording_id = b.recording_id AND s.idx >= greatest(b.peak_idx - 5, 0) AND s.idx < least(l.last_idx, b.peak_idx + 5) GROUP BY 1, 2),
ys AS (SELECT u.recording_id, u.breath_no, u.up, CASE WHEN u.up THEN low ELSE high END AS y FROM up u JOIN lev USING (recording_id, breath_no)),
bst AS (SELECT recording_id, idx, (baseline + lag(baseline) OVER (PARTITION BY recording_id ORDER BY idx)) / 2 AS mid FROM based),
aub AS (SELECT b.recording_id, b.breath_no, any_value(y) AS y_ref, sum(mid - y) * CASE WHEN any_value(up) THEN 1 ELSE -1 END AS area
  FROM breaths b JOIN ys USING (recording_id, breath_no) JOIN bst s ON s.recording_id = b.recording_id AND s.idx > b.start_idx AND s.idx <= b.end_idx GROUP BY 1, 2)"""


def areas(s: SparkSession, d: str) -> DataFrame:
    return metrics.area_under_baseline(based(s, d), breaths(s, d), 1.0, 5)


register("area_under_baseline", with_(SAMPLES, EXTREMA, BREATHS, BASE, AUB) + "SELECT recording_id, breath_no, round(area, 6) AS area, round(y_ref, 6) AS y_ref FROM aub")(
    lambda s, d: areas(s, d).select("recording_id", "breath_no", r6("area", "area"), r6("y_ref", "y_ref"))
)
RATES = """pk AS (SELECT recording_id, idx FROM extrema WHERE is_peak),
rt AS (SELECT recording_id, 60.0 / (idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx)) AS rate FROM pk),
lim AS (SELECT recording_id, 3 * quantile_cont(rate, 0.33) AS cap FROM rt GROUP BY 1),
rates AS (SELECT rt.recording_id, median(CASE WHEN rate <= cap THEN rate END) AS rate, count(rate) AS n_rates FROM rt JOIN lim USING (recording_id) GROUP BY 1)"""
register("respiratory_rate", with_(SAMPLES, EXTREMA, RATES) + "SELECT recording_id, round(rate, 6) AS rate, n_rates FROM rates")(
    lambda s, d: metrics.respiratory_rate(peak_rows(s, d), 1.0).select("recording_id", r6("rate", "rate"), "n_rates")
)
for _name, _method, _low in (("tidal_variation_insp", "inspiratory", "a.value"), ("tidal_variation_exp", "expiratory", "e.value"), ("tidal_variation_mean", "mean", "(a.value + e.value) / 2")):
    register(
        _name,
        with_(SAMPLES, EXTREMA, BREATHS)
        + f"""SELECT b.recording_id, b.breath_no, round(m.value - {_low}, 6) AS tidal_variation FROM breaths b JOIN samples a ON a.recording_id = b.recording_id AND a.idx = b.start_idx
JOIN samples m ON m.recording_id = b.recording_id AND m.idx = b.peak_idx JOIN samples e ON e.recording_id = b.recording_id AND e.idx = b.end_idx""",
    )(lambda s, d, m=_method: metrics.tidal_variation(samples(s, d), breaths(s, d), m).select("recording_id", "breath_no", r6("tidal_variation", "tidal_variation")))
register("eeli", with_(SAMPLES, EXTREMA, BREATHS) + "SELECT b.recording_id, b.breath_no, round(s.value, 6) AS eeli FROM breaths b JOIN samples s ON s.recording_id = b.recording_id AND s.idx = b.end_idx")(
    lambda s, d: metrics.end_expiratory_level(samples(s, d), breaths(s, d)).select("recording_id", "breath_no", r6("eeli", "eeli"))
)
register(
    "estimate_peep",
    with_(SAMPLES, AVERAGE)
    + """SELECT recording_id, round(median(value), 0) AS peep, count(*) AS n_minima FROM (SELECT recording_id, value, average < lag(average) OVER w AND average < lead(average) OVER w AS low FROM averaged
WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) WHERE low GROUP BY 1""",
)(lambda s, d: metrics.estimate_peep(averaged(s, d).withColumnRenamed("average", "volume")))
register(
    "interval_cv",
    with_(SAMPLES, EXTREMA, BREATHS)
    + "SELECT recording_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n, round(stddev_pop(x) / nullif(avg(x), 0), 6) AS cv FROM (SELECT recording_id, CAST(end_idx - start_idx AS DOUBLE) AS x FROM breaths) GROUP BY 1",
)(lambda s, d: metrics.interval_cv(breaths(s, d)).select("recording_id", r6("mean", "mean"), r6("std", "std"), "n", r6("cv", "cv")))

# ---- pixels

LEFT = [1.0 if k % 8 < 4 else None for k in range(64)]
register("global_impedance", with_(FRAMES, WHOLE) + "SELECT recording_id, idx, round(value, 4) AS value FROM whole")(
    lambda s, d: pixels.global_impedance(frames(s, d)).select("recording_id", "idx", F.round("value", 4).alias("value"))
)
register(
    "regional_impedance",
    with_(FRAMES) + "SELECT recording_id, frame_idx AS idx, round(list_sum([pixels[i] FOR i IN range(1, 65) IF (i - 1) % 8 < 4]), 4) AS value FROM frames",
)(lambda s, d: pixels.regional_impedance(frames(s, d), LEFT).select("recording_id", "idx", F.round("value", 4).alias("value")))


def tiv(s: SparkSession, d: str) -> DataFrame:
    return pixels.pixel_tiv(frames(s, d), frame_breaths(s, d))


def amplitude(s: SparkSession, d: str) -> DataFrame:
    return pixels.pixel_amplitude(frames(s, d), frame_breaths(s, d))


AMPLITUDE = """amp AS (SELECT b.recording_id, b.breath_no, z.pixel, max(z.z) - min(z.z) AS amplitude FROM breaths b JOIN z ON z.recording_id = b.recording_id AND z.idx BETWEEN b.start_idx AND b.end_idx GROUP BY ALL),
ameans AS (SELECT recording_id, pixel, avg(amplitude) AS mean FROM amp GROUP BY ALL)"""
_PIX = (FRAMES, WHOLE, FRAME_BREATHS, PIXELS)
register(
    "pixel_tiv",
    # both frames of a breath are joined before their pixels are taken apart
    with_(*[p for p in _PIX if p != PIXELS])
    + """SELECT b.recording_id, b.breath_no, CAST(u.i - 1 AS INTEGER) AS pixel, round(m.pixels[u.i] - s.pixels[u.i], 6) AS tiv FROM breaths b
JOIN frames m ON m.recording_id = b.recording_id AND m.frame_idx = b.peak_idx JOIN frames s ON s.recording_id = b.recording_id AND s.frame_idx = b.start_idx, unnest(range(1, 65)) AS u(i)""",
)(
    lambda s, d: tiv(s, d).select("recording_id", "breath_no", "pixel", r6("tiv", "tiv"))
)
register("tiv_lungspace", with_(*_PIX, TIV, TIVMASK) + "SELECT recording_id, pixel, round(mean, 6) AS mean, included FROM tmask")(
    lambda s, d: pixels.lungspace(tiv(s, d), "tiv").select("recording_id", "pixel", r6("mean", "mean"), "included")
)
register(
    "amplitude_lungspace",
    with_(*_PIX, AMPLITUDE) + "SELECT recording_id, pixel, round(mean, 6) AS mean, mean >= 0.9 * max(mean) OVER (PARTITION BY recording_id) AS included FROM ameans",
)(lambda s, d: pixels.lungspace(amplitude(s, d), "amplitude", 0.9).select("recording_id", "pixel", r6("mean", "mean"), "included"))
register(
    "functional_impedance",
    with_(*_PIX, TIV, TIVMASK) + "SELECT z.recording_id, z.idx, round(sum(z.z), 4) AS value FROM z JOIN tmask m USING (recording_id, pixel) WHERE m.included GROUP BY 1, 2",
)(
    lambda s, d: pixels.masked_impedance(frames(s, d), pixels.lungspace(tiv(s, d), "tiv").select("recording_id", "pixel", F.when(F.col("included"), 1.0).alias("weight"))).select(
        "recording_id", "idx", F.round("value", 4).alias("value")
    )
)
register(
    "pixel_breaths",
    with_(
        *_PIX,
        "zb AS (SELECT b.*, z.idx, z.pixel, z.z FROM breaths b JOIN z ON z.recording_id = b.recording_id AND z.idx BETWEEN b.start_idx AND b.end_idx)",
        "sg AS (SELECT *, CASE WHEN max(CASE WHEN idx = peak_idx THEN z END) OVER w - max(CASE WHEN idx = start_idx THEN z END) OVER w < 0 THEN -z ELSE z END AS u FROM zb WINDOW w AS (PARTITION BY recording_id, breath_no, pixel))",
        "md AS (SELECT recording_id, breath_no, pixel, idx AS middle_idx FROM sg QUALIFY row_number() OVER (PARTITION BY recording_id, breath_no, pixel ORDER BY u DESC, idx) = 1)",
    )
    + """SELECT recording_id, breath_no, pixel,
  first(idx ORDER BY u, idx) FILTER (idx <= middle_idx) AS start_idx, any_value(middle_idx) AS middle_idx, first(idx ORDER BY u, idx) FILTER (idx >= middle_idx) AS end_idx
FROM sg JOIN md USING (recording_id, breath_no, pixel) GROUP BY 1, 2, 3""",
)(lambda s, d: pixels.pixel_breaths(frames(s, d), frame_breaths(s, d)))
register(
    "roi_filter_by_size",
    "WITH RECURSIVE "
    + ",\n".join((*_PIX, AMPLITUDE))
    + """, m AS (SELECT recording_id, pixel FROM (SELECT *, mean >= 0.9 * max(mean) OVER (PARTITION BY recording_id) AS included FROM ameans) WHERE included),
reach AS (SELECT recording_id, pixel, pixel AS root FROM m UNION
  SELECT r.recording_id, n.pixel, r.root FROM reach r JOIN m n ON n.recording_id = r.recording_id AND (abs(n.pixel - r.pixel) = 8 OR (abs(n.pixel - r.pixel) = 1 AND n.pixel // 8 = r.pixel // 8))),
comp AS (SELECT recording_id, pixel, min(root) AS root FROM reach GROUP BY 1, 2),
sized AS (SELECT recording_id, pixel, count(*) OVER (PARTITION BY recording_id, root) AS n FROM comp)
SELECT a.recording_id, a.pixel, coalesce(s.n >= 3, false) AS included FROM ameans a LEFT JOIN sized s USING (recording_id, pixel)""",
)(lambda s, d: pixels.filter_regions(pixels.lungspace(amplitude(s, d), "amplitude", 0.9), 3))
register("roi_watershed")(lambda s, d: pixels.watershed_lungspace(pixels.lungspace(amplitude(s, d), "amplitude"), pixels.lungspace(tiv(s, d), "tiv")))

# ---- slices

register("slice_by_index", with_(SAMPLES) + "SELECT recording_id, idx, round(value, 6) AS value FROM samples WHERE idx >= 10 AND idx < 30")(
    lambda s, d: slicing.slice_signal(samples(s, d), 10, 30).select("recording_id", "idx", r6("value", "value"))
)
register("slice_by_time", with_(SAMPLES) + "SELECT recording_id, idx, round(value, 6) AS value FROM samples WHERE t >= 86400 AND t < 864000")(
    lambda s, d: slicing.slice_signal(samples(s, d), 86400, 864000, "time").select("recording_id", "idx", r6("value", "value"))
)
register(
    "slice_recording",
    with_(SAMPLES, "k AS (SELECT *, t - min(t) OVER (PARTITION BY recording_id) AS since FROM samples)")
    + "SELECT recording_id, idx - min(idx) OVER (PARTITION BY recording_id) AS idx, round(min(since) OVER (PARTITION BY recording_id), 6) AS shift, round(value, 6) AS value FROM k WHERE since >= 86400 AND since < 1728000",
)(lambda s, d: slicing.keep_seconds(samples(s, d), 86400, 1728000).select("recording_id", "idx", r6("shift", "shift"), r6("value", "value")))
register(
    "interpolate_to_time",
    with_(SAMPLES, "grid AS (SELECT recording_id, CAST(g AS DOUBLE) AS t FROM (SELECT DISTINCT recording_id FROM samples), unnest(range(0, 2592000, 86400)) AS u(g))")
    + """SELECT g.recording_id, g.t, round(CASE WHEN a.t = b.t THEN b.value ELSE b.value + (a.value - b.value) * (g.t - b.t) / (a.t - b.t) END, 6) AS value
FROM grid g ASOF LEFT JOIN samples b ON b.recording_id = g.recording_id AND b.t <= g.t ASOF LEFT JOIN samples a ON a.recording_id = g.recording_id AND a.t >= g.t""",
)(
    lambda s, d: slicing.interpolate_to_time(
        samples(s, d), samples(s, d).select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(2591999), F.lit(86400))).alias("t")).withColumn("t", F.col("t").cast("double")),
    ).select("recording_id", "t", r6("value", "value"))
)
register(
    "reduce_points",
    with_(SAMPLES, "c AS (SELECT *, idx * 10 // count(*) OVER (PARTITION BY recording_id) AS chunk FROM samples)")
    + """SELECT recording_id, idx, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk ORDER BY value, idx) AS a, row_number() OVER (PARTITION BY recording_id, chunk ORDER BY value DESC, idx) AS b FROM c)
WHERE a = 1 OR b = 1""",
)(lambda s, d: slicing.reduce_points(samples(s, d), 20).select("recording_id", "idx", r6("value", "value")))
register(
    "concat_recordings",
    with_(SAMPLES, "p AS (SELECT recording_id, CASE WHEN t < 1296000 THEN 1 ELSE 2 END AS part, t, value FROM samples)")
    + """SELECT recording_id, part, row_number() OVER w - 1 AS idx, round(CASE WHEN lag(part) OVER w <> part THEN t - lag(t) OVER w END, 6) AS gap, CASE WHEN lag(part) OVER w <> part THEN t > lag(t) OVER w END AS in_order
FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY part, t)""",
)(
    lambda s, d: slicing.concat_recordings(samples(s, d).select("recording_id", F.when(F.col("t") < 1296000, 1).otherwise(2).alias("part"), "t", "value")).select(
        "recording_id", "part", "idx", r6("gap", "gap"), "in_order"
    )
)

# ---- matching and synchronization

register("closest_event", with_(SAMPLES, EVENTS, nearest_sql("near_a", "eit", "emg")) + "SELECT recording_id, round(t, 6) AS t, round(nearest, 6) AS nearest FROM near_a")(
    lambda s, d: peaks.closest_event(modality(s, d, "eit"), modality(s, d, "emg")).select("recording_id", r6("t", "t"), r6("nearest", "nearest"))
)


def mutual(s: SparkSession, d: str) -> DataFrame:
    return linking.mutual_nearest(modality(s, d, "eit"), modality(s, d, "emg"), TOLERANCE)


register(
    "link_mutual_nearest",
    with_(SAMPLES, EVENTS, MUTUAL) + "SELECT recording_id, round(left_t, 6) AS left_t, round(right_t, 6) AS right_t, round(confidence, 6) AS confidence FROM mutual",
)(lambda s, d: mutual(s, d).select("recording_id", r6("left_t", "left_t"), r6("right_t", "right_t"), r6("confidence", "confidence")))
register("link_breaths_greedy")(lambda s, d: linking.link_greedy(modal(s, d), ("eit", "emg", "ventilator"), TOLERANCE))
register("match_events")(lambda s, d: linking.match_events(modality(s, d, "eit"), modality(s, d, "emg"), TOLERANCE))
register("timing_delay", with_(SAMPLES, EVENTS, MUTUAL) + "SELECT recording_id, round(left_t, 6) AS t_eit, round(right_t - left_t, 6) AS delay FROM mutual")(
    lambda s, d: linking.timing_delay(mutual(s, d).withColumnsRenamed({"left_t": "t_eit", "right_t": "t_emg"}), "eit", "emg").select("recording_id", r6("t_eit", "t_eit"), r6("delay", "delay"))
)
register(
    "duration_difference",
    with_(
        SAMPLES,
        EVENTS,
        MUTUAL,
        "nx AS (SELECT recording_id, modality, t, lead(t) OVER (PARTITION BY recording_id, modality ORDER BY t) AS n FROM modal)",
    )
    + """SELECT m.recording_id, round(left_t, 6) AS start_eit, round((a.n - a.t) - (b.n - b.t), 6) AS duration_difference FROM mutual m
JOIN nx a ON a.recording_id = m.recording_id AND a.modality = 'eit' AND a.t = m.left_t JOIN nx b ON b.recording_id = m.recording_id AND b.modality = 'emg' AND b.t = m.right_t""",
)(lambda s, d: _duration_difference(s, d))


def _duration_difference(s: SparkSession, d: str) -> DataFrame:
    nxt = modal(s, d).select("recording_id", "modality", "t", F.lead("t").over(Window.partitionBy("recording_id", "modality").orderBy("t")).alias("n"))
    links = mutual(s, d).select("recording_id", F.col("left_t").alias("start_eit"), F.col("right_t").alias("start_emg"))
    for m in ("eit", "emg"):
        links = links.join(nxt.where(F.col("modality") == m).select("recording_id", F.col("t").alias(f"start_{m}"), F.col("n").alias(f"end_{m}")), ["recording_id", f"start_{m}"])
    return linking.duration_difference(links, "eit", "emg").select("recording_id", r6("start_eit", "start_eit"), r6("duration_difference", "duration_difference"))


def outer_links(s: SparkSession, d: str) -> DataFrame:
    m = mutual(s, d).withColumnsRenamed({"left_t": "t_eit", "right_t": "t_emg"}).select("recording_id", "t_eit", "t_emg")
    m = modality(s, d, "eit").withColumnRenamed("t", "t_eit").join(m, ["recording_id", "t_eit"], "left")
    return modality(s, d, "emg").withColumnRenamed("t", "t_emg").join(m, ["recording_id", "t_emg"], "full_outer")


OUTER = """l1 AS (SELECT e.recording_id, e.t AS t_eit, m.right_t AS t_emg FROM eit e LEFT JOIN mutual m ON m.recording_id = e.recording_id AND m.left_t = e.t),
links AS (SELECT coalesce(l.recording_id, g.recording_id) AS recording_id, l.t_eit, coalesce(l.t_emg, g.t) AS t_emg FROM emg g FULL JOIN l1 l ON l.recording_id = g.recording_id AND l.t_emg = g.t)"""
register(
    "event_agreement",
    with_(SAMPLES, EVENTS, MUTUAL, OUTER)
    + """SELECT recording_id, n_all, n_any, round(n_all / n_any, 6) AS agreement FROM (SELECT recording_id, CAST(count(*) FILTER (t_eit IS NOT NULL AND t_emg IS NOT NULL) AS BIGINT) AS n_all,
CAST(count(*) AS BIGINT) AS n_any FROM links GROUP BY 1)""",
)(lambda s, d: linking.event_agreement(outer_links(s, d), ("eit", "emg")).select("recording_id", "n_all", "n_any", r6("agreement", "agreement")))
register(
    "event_timing",
    with_(SAMPLES, EVENTS)
    + """SELECT recording_id, a.position, b.t - a.t IS NOT NULL AS paired, round(b.t - a.t, 6) AS delta, coalesce(b.t - a.t BETWEEN -86400 AND 86400, false) AS passed FROM (SELECT recording_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS position FROM eit) a
FULL JOIN (SELECT recording_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS position FROM emg) b USING (recording_id, position)""".replace("a.position", "position"),
)(lambda s, d: quality.event_timing(modality(s, d, "eit"), modality(s, d, "emg"), -86400, 86400).select("recording_id", "position", "paired", r6("delta", "delta"), "passed"))
register(
    "align_by_modality_offset",
    with_(SAMPLES, EVENTS) + "SELECT recording_id, modality, event_id, round(t + CASE modality WHEN 'emg' THEN 5 WHEN 'ventilator' THEN -2 ELSE 0 END, 6) AS t FROM modal",
)(lambda s, d: linking.shift_by_modality(modal(s, d), OFFSETS).select("recording_id", "modality", "event_id", r6("t", "t")))
register(
    "shared_clock",
    with_(SAMPLES) + "SELECT recording_id, idx, round(t - min(t) OVER (PARTITION BY recording_id) + CASE WHEN recording_id % 2 = 0 THEN recording_id * 0.5 ELSE 0 END, 6) AS shared_t FROM samples",
)(
    lambda s, d: linking.shared_clock(
        samples(s, d), samples(s, d).where("recording_id % 2 = 0").select("recording_id", (F.col("recording_id") * 0.5).alias("start_time")).distinct()
    ).select("recording_id", "idx", r6("shared_t", "shared_t"))
)
register("timing_parameters")(lambda s, d: linking.timing_parameters(linking.link_greedy(modal(s, d), ("eit", "emg", "ventilator"), TOLERANCE), ("eit", "emg", "ventilator")))

# ---- quality flags

register(
    "threshold_flags",
    with_(SAMPLES, EXTREMA, BREATHS, BASE)
    + "SELECT b.recording_id, b.breath_no, 'amplitude' AS flag, s.value - s.baseline >= 20 AS passed FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx",
)(lambda s, d: quality.threshold_flag(metrics.amplitude_at_peaks(based(s, d), breaths(s, d), "baseline"), "amplitude", "amplitude", 20, ">=").select("recording_id", "breath_no", "flag", "passed"))
register(
    "fraction_flag",
    with_(SAMPLES, EXTREMA, BREATHS, BASE)
    + """SELECT recording_id, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS fraction, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed
FROM (SELECT b.recording_id, s.value - s.baseline >= 20 AS ok FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx) GROUP BY 1""",
)(
    lambda s, d: quality.fraction_flag(quality.threshold_flag(metrics.amplitude_at_peaks(based(s, d), breaths(s, d), "baseline"), "amplitude", "amplitude", 20, ">="), "enough", "passed", 0.5).select(
        "recording_id", r6("fraction", "fraction"), "passed"
    )
)
register(
    "timing_window_flag",
    with_(SAMPLES, EVENTS, MUTUAL) + "SELECT recording_id, bool_and(right_t - left_t >= -30000 AND right_t - left_t <= 30000) AS passed, count(*) AS n FROM mutual GROUP BY 1",
)(lambda s, d: quality.timing_window_flag(mutual(s, d).withColumn("delta", F.col("right_t") - F.col("left_t")), "timing", "delta", -30000, 30000).select("recording_id", "passed", "n"))
register(
    "local_high_aub",
    with_(SAMPLES, EXTREMA, BREATHS, BASE, AUB)
    + "SELECT recording_id, breath_no, round(4 * q, 6) AS threshold, area <= 4 * q AS passed FROM (SELECT *, quantile_cont(area, 0.75) OVER (PARTITION BY recording_id) AS q FROM aub)",
)(lambda s, d: quality.local_high_aub(areas(s, d)).select("recording_id", "breath_no", r6("threshold", "threshold"), "passed"))
register(
    "extreme_time_products",
    with_(SAMPLES, EXTREMA, BREATHS, BASE, PRODUCT)
    + """SELECT recording_id, breath_no, round(0.1 * a + 3.3e-9, 6) AS low, round(10 * b + 3.3e-9, 6) AS high, time_product >= 0.1 * a AND time_product <= 10 * b AS passed
FROM (SELECT *, quantile_cont(time_product, 0.05) OVER (PARTITION BY recording_id) AS a, quantile_cont(time_product, 0.95) OVER (PARTITION BY recording_id) AS b FROM product)""",
)(
    lambda s, d: quality.extreme_time_products(metrics.time_product(based(s, d), breaths(s, d), 1.0, "baseline")).select(
        "recording_id", "breath_no", r6(F.col("low") + NUDGE, "low"), r6(F.col("high") + NUDGE, "high"), "passed"
    )
)
register(
    "interpeak_distance",
    with_(SAMPLES, EXTREMA)
    + """SELECT recording_id, round(b.d / a.d, 6) AS ratio, b.d / a.d > 1.1 AS passed FROM
(SELECT recording_id, median(d) AS d FROM (SELECT recording_id, CAST(idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) AS DOUBLE) AS d FROM extrema WHERE is_peak) GROUP BY 1) a JOIN
(SELECT recording_id, median(d) AS d FROM (SELECT recording_id, CAST(idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) AS DOUBLE) AS d FROM extrema WHERE is_valley AND value < 50) GROUP BY 1) b USING (recording_id)""",
)(
    lambda s, d: quality.interpeak_distance(peak_rows(s, d), peaks.strict_extrema(samples(s, d)).where("is_valley AND value < 50").select("recording_id", "idx")).select(
        "recording_id", r6("ratio", "ratio"), "passed"
    )
)
register(
    "respiratory_rate_agreement",
    with_(
        SAMPLES,
        EXTREMA,
        RATES,
        "n AS (SELECT recording_id, count(*) FILTER (is_peak AND value > 100) AS n_breaths, CAST(count(*) AS DOUBLE) AS duration FROM extrema GROUP BY 1)",
    )
    + "SELECT recording_id, round(n_breaths / (duration / 60) / rate, 6) AS fraction, coalesce(n_breaths / (duration / 60) / rate > 0.1, false) AS passed FROM n JOIN rates USING (recording_id)",
)(lambda s, d: _rate_agreement(s, d))


def _rate_agreement(s: SparkSession, d: str) -> DataFrame:
    e = peaks.strict_extrema(samples(s, d))
    n = e.groupBy("recording_id").agg(F.count_if(F.expr("is_peak AND value > 100")).alias("n_breaths"), F.count(F.lit(1)).cast("double").alias("duration"))
    counts = n.join(metrics.respiratory_rate(peak_rows(s, d), 1.0), "recording_id")
    return quality.rate_agreement(counts).select("recording_id", r6("fraction", "fraction"), "passed")


register(
    "percentage_under_baseline",
    with_(SAMPLES, EXTREMA, BREATHS, BASE, PRODUCT, AUB)
    + f"""SELECT recording_id, breath_no, round(100 * area / nullif(area + time_product, 0) + {NUDGE}, 4) AS percentage, coalesce(round(100 * area / nullif(area + time_product, 0), 9) <= 40, false) AS passed
FROM aub JOIN product USING (recording_id, breath_no)""",
)(lambda s, d: rounded_share(quality.percentage_under_baseline(areas(s, d), metrics.time_product(based(s, d), breaths(s, d), 1.0, "baseline"))))
register(
    "snr_pseudo",
    with_(
        SAMPLES,
        EXTREMA,
        BREATHS,
        BASE,
        "noise AS (SELECT b.recording_id, b.breath_no, median(s.baseline) AS noise FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx BETWEEN greatest(b.peak_idx - 4, 0) AND b.peak_idx + 4 GROUP BY 1, 2)",
    )
    + "SELECT b.recording_id, b.breath_no, round(s.value / nullif(n.noise, 0), 4) AS snr FROM breaths b JOIN noise n USING (recording_id, breath_no) JOIN samples s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx",
)(lambda s, d: metrics.snr_pseudo(based(s, d), breaths(s, d), 8.0).select("recording_id", "breath_no", F.round("snr", 4).alias("snr")))
register(
    "pocc_quality",
    with_(
        SAMPLES,
        EXTREMA,
        BREATHS,
        BASE,
        PRODUCT,
        "dp AS (SELECT recording_id, idx, value - lag(value) OVER (PARTITION BY recording_id ORDER BY idx) AS dp FROM samples)",
    )
    + """SELECT recording_id, breath_no, round(p10, 4) AS p10, round(p90, 4) AS p90, round(p90 / nullif(sqrt(tp), 0), 4) AS p90_norm, coalesce(p10 >= -200 AND p90 <= 0 AND p90 / nullif(sqrt(tp), 0) <= 0.8, false) AS passed
FROM (SELECT b.recording_id, b.breath_no, quantile_cont(dp, 0.1) AS p10, quantile_cont(dp, 0.9) AS p90, any_value(p.time_product) AS tp FROM breaths b JOIN product p USING (recording_id, breath_no)
JOIN dp ON dp.recording_id = b.recording_id AND dp.idx > b.peak_idx AND dp.idx <= b.end_idx GROUP BY 1, 2)""",
)(
    lambda s, d: quality.pocc_quality(
        samples(s, d), breaths(s, d).join(metrics.time_product(based(s, d), breaths(s, d), 1.0, "baseline"), ["recording_id", "breath_no"]), (-200.0, 0.0, 0.8)
    ).select("recording_id", "breath_no", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"), F.round("p90_norm", 4).alias("p90_norm"), "passed")
)
register(
    "non_consecutive_manoeuvres",
    with_(
        SAMPLES,
        "m AS (SELECT recording_id, idx, lead(idx) OVER (PARTITION BY recording_id ORDER BY idx) AS nxt FROM samples WHERE event_type = 'purchase')",
    )
    + """SELECT recording_id, idx, n_between, coalesce(n_between = 0, true) AS valid FROM (SELECT recording_id, idx, CASE WHEN nxt IS NOT NULL THEN (SELECT count(*) FROM samples b WHERE b.recording_id = m.recording_id
AND b.event_type = 'view' AND b.idx > m.idx AND b.idx < m.nxt) END AS n_between FROM m)""",
)(lambda s, d: quality.non_consecutive(samples(s, d).where("event_type = 'view'"), samples(s, d).where("event_type = 'purchase'")))
register("bell_curve_error")(
    lambda s, d: quality.bell_curve_error(samples(s, d), breaths(s, d), 1.0).select("recording_id", "breath_no", F.round("error", 3).alias("error"), "passed")
)
FLAGS = """flags AS (SELECT b.recording_id, b.breath_no, 'amplitude' AS name, 1 AS seq, s.value - s.baseline >= 20 AS passed FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx
  UNION ALL SELECT recording_id, breath_no, 'amplitude', 2, true FROM breaths WHERE breath_no = 0 UNION ALL SELECT recording_id, breath_no, 'length', 3, end_idx - start_idx > 2 FROM breaths)"""
register(
    "remove_invalid_breaths",
    with_(SAMPLES, EXTREMA, BREATHS, BASE, FLAGS)
    + """SELECT b.recording_id, b.breath_no, b.start_idx, b.peak_idx, b.end_idx FROM breaths b WHERE NOT EXISTS (SELECT 1 FROM (SELECT recording_id, breath_no, name, arg_max(passed, seq) AS passed FROM flags GROUP BY ALL) f
WHERE f.recording_id = b.recording_id AND f.breath_no = b.breath_no AND NOT f.passed)""",
)(lambda s, d: _remove_invalid(s, d))


def _remove_invalid(s: SparkSession, d: str) -> DataFrame:
    b = breaths(s, d)
    high = quality.threshold_flag(metrics.amplitude_at_peaks(based(s, d), b, "baseline"), "amplitude", "amplitude", 20, ">=").select("recording_id", "breath_no", F.lit("amplitude").alias("name"), F.lit(1).alias("seq"), "passed")
    first = b.where("breath_no = 0").select("recording_id", "breath_no", F.lit("amplitude").alias("name"), F.lit(2).alias("seq"), F.lit(True).alias("passed"))
    long = b.select("recording_id", "breath_no", F.lit("length").alias("name"), F.lit(3).alias("seq"), (F.col("end_idx") - F.col("start_idx") > 2).alias("passed"))
    kept = quality.remove_invalid_breaths(b, reduce(DataFrame.unionByName, (high, first, long)), ("amplitude", "length"))
    return kept.select("recording_id", "breath_no", "start_idx", "peak_idx", "end_idx")


# ---- integrity

RULES = (("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"),
         ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels.document", "labels", "doc_id", "documents", "doc_id"), ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"))
register(
    "validate_references",
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS violations FROM {c} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {pk} = {k})" for n, c, k, p, pk in RULES),
)(lambda s, d: validation.check_references({n: (table(s, d, c), k, table(s, d, p), pk) for n, c, k, p, pk in RULES}))
register(
    "validate_time_windows",
    """SELECT 'shipped before ordered' AS rule, count(*) AS violations FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'order after its last date' AS rule, count(*) AS violations FROM orders WHERE o_orderdate < o_orderdate""",
)(
    lambda s, d: validation.check_time_windows(
        {
            "shipped before ordered": (table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")), "o_orderdate", "l_shipdate"),
            "order after its last date": (table(s, d, "orders"), "o_orderdate", "o_orderdate"),
        }
    )
)
register(
    "validate_completeness",
    " UNION ALL ".join(f"SELECT 'events.{c} present' AS rule, count(*) FILTER ({c} IS NULL) AS violations FROM events" for c in ("event_id", "ts", "user_id", "value", "props")),
)(lambda s, d: validation.check_complete(table(s, d, "events"), ["event_id", "ts", "user_id", "value", "props"], "events."))
EVENT_NAMES = vocabulary.Vocabulary({"view": "impedance", "click": "emg", "purchase": "volume"})
register(
    "normalize_vocabulary",
    "SELECT event_id, CASE lower(trim(event_type)) WHEN 'view' THEN 'impedance' WHEN 'click' THEN 'emg' WHEN 'purchase' THEN 'volume' ELSE trim(event_type) END AS category FROM events",
)(lambda s, d: table(s, d, "events").select("event_id", EVENT_NAMES.column(F.col("event_type")).alias("category")))
register(
    "stable_ids",
    "SELECT event_id, sha256(concat(" + ", ".join(f"coalesce(concat(length({c}), ':', {c}), '-')" for c in ("CAST(user_id AS VARCHAR)", "event_type")) + ")) AS id FROM events",
)(lambda s, d: table(s, d, "events").select("event_id", vocabulary.stable_id(F.col("user_id").cast("string"), F.col("event_type")).alias("id")))

# ---- filters and other kernels

for _name, _kind, _cut in (("lowpass_filter", "lowpass", 0.1), ("highpass_filter", "highpass", 0.05), ("bandpass_filter", "bandpass", (0.05, 0.2)), ("bandstop_filter", "bandstop", (0.1, 0.2))):
    register(_name)(lambda s, d, k=_kind, c=_cut: summary(filters.butterworth(packed(s, d), k, c, 1.0, 4)))
register("notch_filter")(lambda s, d: summary(filters.notch(packed(s, d), 0.1, 1.0)))
register("harmonic_notch_filter")(lambda s, d: summary(filters.harmonic_notch(packed(s, d), 0.1, 1.0)))
register("mdn_filter")(lambda s, d: summary(filters.multiple_digital_notch(packed(s, d), 0.25, 1.2, 10.0)))
register("power_loss")(lambda s, d: filters.power_loss(packed(s, d), 1.0, "lowpass", 0.1).select("recording_id", F.round("loss", 4).alias("loss")))
register("detect_rates")(lambda s, d: filters.detect_rates(packed(s, d), 10.0).select("recording_id", r6("respiratory_hz", "respiratory_hz"), r6("heart_hz", "heart_hz")))
#: A heart beat of seven samples, which recurs every 160.
BEAT = (-0.1, -0.4, 1.0, 3.0, 0.8, -0.6, -0.1)


def beating(spark: SparkSession, d: str) -> DataFrame:
    """A recording for each region: prices as the muscle's noise, and a beat every 0.8 s at 200 Hz."""
    beat = F.array(*[F.lit(x) for x in BEAT])
    prices = bindings.region_prices(spark, d)
    return prices.withColumn("value", F.col("value") / 1e6 + F.coalesce(F.get(beat, (F.col("idx") % 160 - 40).cast("int")), F.lit(0.0)))


register("ecg_template_subtraction")(lambda s, d: summary_of_samples(heartbeats.subtract(beating(s, d), 200.0, strict=False)))
register(
    "ecg_complexes",
    """SELECT r_regionkey AS recording_id, count(*) AS n FROM (
  SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) t,
unnest(range(43, n, 160)) AS u(r) WHERE r >= 30 AND r + 31 <= n GROUP BY 1""",
)(lambda s, d: heartbeats.complexes(beating(s, d), 200.0).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")))
for _fill in range(4):
    register(f"ecg_gating_{_fill}")(lambda s, d, f=_fill: summary(filters.gate_ecg(packed(s, d), 10.0, 6, f)))
register("wavelet_denoise")(lambda s, d: summary(filters.wavelet_denoise(packed(s, d), 10.0, 6)))


def _more() -> list:
    """Modules of queries that build on this one."""
    from pneumaspark.plans import file_queries, long_queries, workflow_queries

    return [workflow_queries, file_queries, long_queries]


def queries() -> dict[str, Query]:
    out = dict(_QUERIES)
    for module in _more():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(_SQL)
    for module in _more():
        out |= module.SQL
    return out
