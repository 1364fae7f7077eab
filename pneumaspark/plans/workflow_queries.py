"""Queries over the workflow language: the presets, and the closure of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pneumaspark.plans import steps, workflow
from pneumaspark.plans.catalog import BASE, BREATHS, EXTREMA, PRODUCT, SAMPLES, with_
from pneumaspark.sources import bindings

assert steps

EMG_PRESET = """
version: 1
name: emg-preset
inputs: {fs: 1.0}
steps:
  - {step: emg.envelope, in: {samples: raw}, with: {fs: "@fs", window_seconds: 5, method: rms}, out: envelope}
  - {step: emg.moving_baseline, in: {samples: envelope}, with: {fs: "@fs", window_seconds: 15, step_seconds: 5}, out: based}
  - {step: emg.detect_breaths_valleys, in: {samples: based}, out: breaths}
  - {step: emg.amplitude, in: {samples: based}, out: amplitudes}
  - {step: emg.time_product, in: {samples: based}, with: {fs: "@fs"}, out: products}
  - {step: emg.detect_extreme_time_products, in: {time_products: products}, out: flagged}
outputs: {amplitudes: amplitudes, flagged: flagged, breaths: breaths}
"""


def workflow_emg_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope, baseline, breaths, features and a flag, from a YAML document to one plan."""
    out = workflow.run_spec(EMG_PRESET, {"raw": bindings.event_samples(spark, sf_dir)})
    keys = ["recording_id", "breath_no"]
    joined = out["breaths"].join(out["amplitudes"], keys).join(out["flagged"].select(*keys, "time_product", "passed"), keys)
    return joined.select(*keys, "start_idx", "peak_idx", "end_idx", F.round("amplitude", 6).alias("amplitude"), F.round("time_product", 6).alias("time_product"), "passed")


def workflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset's graph as rows (producer, consumer, key)."""
    graph = workflow.to_graph(EMG_PRESET, ("raw",))
    return spark.createDataFrame([(e["producer"], e["consumer"], e["key"]) for e in graph["edges"]], "producer int, consumer int, key string")


def downstream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that a change of step 1 reaches."""
    return workflow.downstream(workflow_edges(spark, sf_dir), 1)


_EDGES = "edges AS (SELECT * FROM (VALUES (0, 1, 'envelope'), (1, 2, 'based'), (1, 3, 'based'), (2, 3, 'breaths'), (1, 4, 'based'), (2, 4, 'breaths'), (4, 5, 'products')) e(producer, consumer, key))"

QUERIES = {f.__name__: f for f in (workflow_emg_preset, workflow_edges, downstream_steps)}
SQL: dict[str, str] = {
    "workflow_emg_preset": with_(
        SAMPLES.replace("samples AS", "raw AS"),
        "samples AS (SELECT recording_id, idx, t, sqrt(avg(value * value) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS value FROM raw)",
        BASE,
        EXTREMA,
        BREATHS,
        PRODUCT,
    )
    + """SELECT b.recording_id, b.breath_no, b.start_idx, b.peak_idx, b.end_idx, round(s.value - s.baseline, 6) AS amplitude, round(p.time_product, 6) AS time_product,
  p.time_product >= 0.1 * p.a AND p.time_product <= 10 * p.z AS passed
FROM breaths b JOIN based s ON s.recording_id = b.recording_id AND s.idx = b.peak_idx
JOIN (SELECT *, quantile_cont(time_product, 0.05) OVER (PARTITION BY recording_id) AS a, quantile_cont(time_product, 0.95) OVER (PARTITION BY recording_id) AS z FROM product) p
  ON p.recording_id = b.recording_id AND p.breath_no = b.breath_no""",
    "workflow_edges": f"WITH {_EDGES} SELECT producer, consumer, key FROM edges",
    "downstream_steps": f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 1 AS position UNION SELECT e.consumer FROM reach r JOIN edges e ON e.producer = r.position) SELECT position FROM reach",
}
