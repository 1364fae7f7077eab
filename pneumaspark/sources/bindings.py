"""Bindings of Parquet tables to the logical signal model.

``samples`` has recording_id, idx, t (seconds on the recording's clock), value;
``frames`` has recording_id, frame_idx, pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pneumaspark.session import table

EPOCH_US = 1704067200000000


def seconds(ts: Column) -> Column:
    """Seconds since the first of January 2024 of a timestamp without zone (read as UTC)."""
    return (F.unix_micros(ts.cast("timestamp")) - EPOCH_US) / F.lit(1e6)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording for each user: its events in time order, with the event type beside the value."""
    w = Window.partitionBy("recording_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "event_id", "ts", "event_type", "value")
    return e.select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), seconds(F.col("ts")).alias("t"), "value", "event_type")


def price_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer recording for each supplier: its line items' prices at one sample a second."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem")
    numbered = li.select(F.col("l_suppkey").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("l_extendedprice").alias("value"))
    return numbered.select("recording_id", "idx", F.col("idx").cast("double").alias("t"), "value")


#: Consecutive keys of orders that make a run of rows.
RUN = 1 << 14


def numbered(rows: DataFrame, by: str, order: Sequence[str], run: Column, name: str = "idx") -> DataFrame:
    """Rows with their number from 0 on among those of equal ``by``, in the given order, however many they are.

    ``run`` never falls in that order: rows are numbered within a run, after the rows of all runs before
    it, which one small table counts.  So no task sorts more than a few runs.
    """
    placed = rows.withColumn("_run", run)
    upto = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col(by).alias("_by"), F.col("_run").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_by", "_at", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order)) - 1
    own = placed.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_run").eqNullSafe(F.col("_at")))
    return own.withColumn(name, (F.col("_before") + within).cast("long")).drop("_run", "_by", "_at", "_before")


def order_run(key: str) -> Column:
    return F.floor(F.col(key) / F.lit(RUN)).cast("long")


def region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long recording for each region of the suppliers: its line items' prices."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("recording_id"))
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").join(nation, "n_nationkey").select("recording_id", *order)
    return numbered(li, "recording_id", order, order_run("l_orderkey")).select("recording_id", "idx", F.col("l_extendedprice").alias("value"))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 pixels: a recording for each label, in the order of vec_id."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("recording_id"),
        (F.row_number().over(w) - 1).cast("long").alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("pixels"),
    )


def pack(samples: DataFrame) -> DataFrame:
    """(recording_id, values): one array for each recording, in the order of idx."""
    rows = samples.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    return rows.select("recording_id", F.col("rows.value").alias("values"))


def unpack(packed: DataFrame, column: str = "values", name: str = "value") -> DataFrame:
    """(recording_id, idx, value) of packed recordings."""
    out = packed.select("recording_id", F.posexplode(column).alias("idx", name))
    return out.withColumn("idx", F.col("idx").cast("long"))
