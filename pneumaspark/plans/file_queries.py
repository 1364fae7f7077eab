"""Queries that write recordings of the tables to files, read them back and use them.

A session is a nation or a label: its frame file holds embeddings as images, its Poly5 file
the prices and quantities of its suppliers' line items, and another one its customers' orders.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pneumaspark.operators import clocks, linking, peaks, pixels
from pneumaspark.plans.catalog import FRAMES, WHOLE, with_
from pneumaspark.session import materialize, shared_dir, table
from pneumaspark.sources import binary_files, recordings
from pneumaspark.sources.bindings import embedding_frames, numbered, order_run

FS = {"eit": 20.0, "emg": 10.0, "ventilator": 5.0}
#: No two recordings have samples at equal distances from one of another, so nearest ones are no matter of rounding.
STARTS = {"eit": 0.0, "emg": 1.537, "ventilator": -0.771}
TOLERANCE = 0.5
PAIRS = (("eit", "emg"), ("emg", "ventilator"))
#: Line numbers repeat within an order.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_as() -> Column:
    """The recording that a file was written for, by the name that the writer gave it."""
    return F.regexp_extract("path", "recording-(-?[0-9]+)-", 1)


def frame_files(spark: SparkSession, sf_dir: str) -> str:
    """A frame file for each label, 64 of its 1024 pixels set; frames are a twentieth of a second apart."""
    frames = embedding_frames(spark, sf_dir)
    empty = F.array_repeat(F.lit(0.0), binary_files.FRAME_PIXELS - 64)
    path = _folder(spark, "frames")
    recordings.write_frames(frames.select("recording_id", "frame_idx", (F.col("frame_idx") / FS["eit"]).alias("t"), F.concat("pixels", empty).alias("pixels")), path)
    return path


def price_files(spark: SparkSession, sf_dir: str) -> str:
    """A Poly5 file for each nation of the suppliers: prices as EMGdi, quantities as ECG."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("recording_id"))
    lines = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").select("recording_id", *LINE_ORDER)
    rows = numbered(lines, "recording_id", LINE_ORDER, order_run("l_orderkey"))
    both = F.explode(F.array(F.struct(F.lit("EMGdi").alias("channel"), F.col("l_extendedprice").alias("value")), F.struct(F.lit("ECG").alias("channel"), F.col("l_quantity").alias("value"))))
    path = _folder(spark, "prices")
    recordings.write_poly5(rows.select("recording_id", "idx", both.alias("c")).select("recording_id", "idx", "c.channel", "c.value"), path, FS["emg"], {"ECG": "mV", "EMGdi": "uV"})
    return path


def order_files(spark: SparkSession, sf_dir: str) -> str:
    """A Poly5 file for each nation of the customers: order totals as Paw."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("recording_id"))
    totals = table(spark, sf_dir, "orders").join(customer, "o_custkey").select("recording_id", "o_orderkey", "o_totalprice")
    rows = numbered(totals, "recording_id", ("o_orderkey",), order_run("o_orderkey")).select("recording_id", "idx", F.lit("Paw").alias("channel"), F.col("o_totalprice").alias("value"))
    path = _folder(spark, "orders")
    recordings.write_poly5(rows, path, FS["ventilator"], {"Paw": "cmH2O"})
    return path


def eit_frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's frames, last time and sum of pixels, from files."""
    frames = recordings.read_frames(spark, frame_files(spark, sf_dir), task_bytes=1 << 20)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return frames.groupBy(written_as().cast("long").alias("recording_id")).agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.max("t"), 6).alias("last_t"), F.round(F.sum(total), 4).alias("total"))


def eit_frame_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to seventh frame of each recording's file; the bytes of the others aren't read."""
    frames = recordings.read_frames(spark, frame_files(spark, sf_dir), first=2, most=5)
    return frames.select(written_as().cast("long").alias("recording_id"), "frame_idx", F.round("t", 6).alias("t"), F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def emg_poly5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel's samples, peak and mean square, from files."""
    samples = recordings.read_poly5(spark, price_files(spark, sf_dir), task_bytes=1 << 18)
    v = F.col("value")
    return samples.groupBy(written_as().cast("long").alias("recording_id"), "channel", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(v), 4).alias("peak"), F.round(F.avg(v * v), 2).alias("mean_square"))


def _peaks(samples: DataFrame, fs: float) -> DataFrame:
    return peaks.strict_extrema(samples).where("is_peak").select("recording_id", (F.col("idx") / F.lit(fs)).alias("t"))


def session_files_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of three files of each session on its clock, and which are each other's nearest."""
    paths = {"eit": frame_files(spark, sf_dir), "emg": price_files(spark, sf_dir), "ventilator": order_files(spark, sf_dir)}
    frames = recordings.read_frames(spark, paths["eit"])
    raw = {"eit": pixels.global_impedance(frames), "emg": recordings.read_poly5(spark, paths["emg"], channels=["EMGdi"]), "ventilator": recordings.read_poly5(spark, paths["ventilator"])}
    heads = {"eit": recordings.frame_files(spark, paths["eit"]), "emg": recordings.poly5_channels(spark, paths["emg"]), "ventilator": recordings.poly5_channels(spark, paths["ventilator"])}
    dimension = reduce(DataFrame.unionByName, [clocks.clock_rows(about, modality, written_as()) for modality, about in heads.items()])
    dimension = materialize(clocks.moved(dimension, STARTS), "clocks")
    # each side of a match is read four times, files once
    placed = {m: materialize(clocks.on_shared_clock(_peaks(x, FS[m]), dimension.where(F.col("modality") == m), ("t",)).select(F.col("session_id").cast("long").alias("recording_id"), "t"), "peaks") for m, x in raw.items()}
    # both pairs of modalities are matched at once, under keys of their own
    left, right = (
        reduce(DataFrame.unionByName, [placed[pair[side]].select((F.col("recording_id") * len(PAIRS) + k).alias("recording_id"), "t") for k, pair in enumerate(PAIRS)]) for side in (0, 1)
    )
    pairs = linking.mutual_nearest(left, right, TOLERANCE)
    names = [F.element_at(F.array(*[F.lit(pair[side]) for pair in PAIRS]), (F.col("recording_id") % len(PAIRS) + 1).cast("int")) for side in (0, 1)]
    return pairs.select(
        F.expr(f"recording_id div {len(PAIRS)}").alias("session_id"), names[0].alias("left_modality"), names[1].alias("right_modality"),
        F.round("left_t", 6).alias("left_t"), F.round("right_t", 6).alias("right_t"), F.round("confidence", 6).alias("confidence"),
    )


_PRICES = f"""prices AS (
  SELECT CAST(s_nationkey AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS idx,
    CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
_ORDERS = """totals AS (
  SELECT CAST(c_nationkey AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS idx, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _peak_sql(name: str, source: str, value: str, modality: str) -> str:
    return f"""{name} AS (
  SELECT recording_id, idx / CAST({FS[modality]} AS DOUBLE) + CAST({STARTS[modality]} AS DOUBLE) AS t FROM (
    SELECT recording_id, idx, {value} > lag({value}) OVER w AND {value} > lead({value}) OVER w AS top FROM {source} WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) WHERE top)"""


def _nearest_sql(name: str, left: str, right: str) -> str:
    """The nearest time on the other side, the earlier on a tie: of the last one at or before and the first one after."""
    return f"""{name} AS (
  SELECT recording_id, t, CASE WHEN after IS NULL OR abs(t - before) <= abs(after - t) THEN before ELSE after END AS nearest FROM (
    SELECT recording_id, t, side, max(CASE WHEN side = 1 THEN t END) OVER (PARTITION BY recording_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
      min(CASE WHEN side = 1 THEN t END) OVER (PARTITION BY recording_id ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM (SELECT recording_id, t, 0 AS side FROM {left} UNION ALL SELECT recording_id, t, 1 FROM {right})) WHERE side = 0)"""


def _mutual_sql(left: str, right: str) -> str:
    a, b = f"{left}_{right}", f"{right}_{left}"
    return (
        f"SELECT a.recording_id AS session_id, '{left}' AS left_modality, '{right}' AS right_modality, round(a.t, 6) AS left_t, round(b.t, 6) AS right_t, round(greatest(0, 1 - abs(a.t - b.t) / {TOLERANCE}), 6) AS confidence "
        f"FROM {a} a JOIN {b} b ON b.recording_id = a.recording_id AND a.nearest = b.t AND b.nearest = a.t WHERE abs(a.t - b.t) <= {TOLERANCE}"
    )


QUERIES = {f.__name__: f for f in (eit_frame_files, eit_frame_window, emg_poly5_files, session_files_linked)}
SQL: dict[str, str] = {
    "eit_frame_files": with_(FRAMES) + "SELECT recording_id, count(*) AS n_frames, round(max(frame_idx) / 20.0, 6) AS last_t, round(sum(list_sum(pixels)), 4) AS total FROM frames GROUP BY recording_id",
    "eit_frame_window": with_(FRAMES) + "SELECT recording_id, frame_idx, round(frame_idx / 20.0, 6) AS t, round(list_sum(pixels), 6) AS total FROM frames WHERE frame_idx BETWEEN 2 AND 6",
    "emg_poly5_files": with_(_PRICES)
    + """SELECT recording_id, channel, unit, count(*) AS n, round(max(value), 4) AS peak, round(avg(value * value), 2) AS mean_square
FROM (SELECT recording_id, 'EMGdi' AS channel, 'uV' AS unit, price AS value FROM prices UNION ALL SELECT recording_id, 'ECG', 'mV', quantity FROM prices) GROUP BY ALL""",
    "session_files_linked": with_(
        FRAMES,
        WHOLE,
        _PRICES,
        _ORDERS,
        _peak_sql("eit", "whole", "value", "eit"),
        _peak_sql("emg", "prices", "price", "emg"),
        _peak_sql("ventilator", "totals", "value", "ventilator"),
        *(_nearest_sql(f"{a}_{b}", a, b) for a, b in (("eit", "emg"), ("emg", "eit"), ("emg", "ventilator"), ("ventilator", "emg"))),
    )
    + _mutual_sql("eit", "emg")
    + " UNION ALL "
    + _mutual_sql("emg", "ventilator"),
}
