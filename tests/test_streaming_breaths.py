"""Breaths of a shuffled stream are those of the whole recording."""

import numpy as np
from pyspark.sql import functions as F

from pneumaspark.operators import peaks
from pneumaspark.streaming import breaths


def test_shuffled_micro_batches_give_the_same_breaths(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(r, k, float(v)) for r in (1, 2) for k, v in enumerate(np.sin(np.arange(300) / 4) + 0.3 * rng.standard_normal(300))]
    samples = spark.createDataFrame(rows, "recording_id long, idx long, value double").withColumn("ts", F.timestamp_millis(1_700_000_000_000 + F.col("idx") * 100)).cache()
    want = {tuple(r) for r in peaks.valley_peak_valley(peaks.strict_extrema(samples)).select("recording_id", "start_idx", "peak_idx", "end_idx").collect()}
    # files of 50 samples, each with rows of its neighbours: at most five seconds out of order
    place = (F.col("idx") + (F.rand(3) * 40).cast("int")) / 50
    for k in range(7):
        samples.where(place.cast("int") == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = samples.agg(F.max("ts").alias("t")).selectExpr("9L AS recording_id", "0L AS idx", "0D AS value", "t + INTERVAL 1 HOUR AS ts")
    for k in range(2):  # pushes the watermark past everything
        last.withColumn("idx", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = samples.where("idx = 3").withColumn("value", F.lit(99.0)).coalesce(1)
    late.write.mode("append").parquet(str(tmp_path / "in"))  # an hour late: dropped
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", breaths.ROCKSDB)
    try:
        stream = spark.readStream.schema("recording_id long, idx long, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = breaths.timed_breaths(stream).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(150)
        got = [tuple(r) for r in spark.table("timed").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
        assert sum(p["numInputRows"] for p in query.recentProgress) == 600 + 2 + 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
