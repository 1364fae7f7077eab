"""The relational store: tables with keys, lookups, integrity checks and recorders.

A store is a dict of lazy DataFrames.  Recorders turn session tables into store
rows with deterministic ids, so recording the same thing twice changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pneumaspark import export
from pneumaspark.functions.vocabulary import categories, stable_id, units
from pneumaspark.operators import validation

# The tables and their columns.
TABLES: dict[str, str] = {
    "cases": "case_id string, label string",
    "sessions": "session_id string, case_id string, start_time double, notes string",
    "devices": "device_id string, name string, vendor string",
    "signal_streams": "signal_id string, session_id string, device_id string, modality string, category string, channel string, unit string, fs double, start_time double, sync_method string, time_offset_ms double",
    "eit_configurations": "signal_id string, n_rows int, n_cols int",
    "emg_channels": "signal_id string, muscle string, side string",
    "ventilator_settings": "setting_id string, session_id string, device_id string, name string, value double, time double",
    "breaths": "breath_id string, session_id string, signal_id string, start_time double, end_time double, extremum_time double",
    "clinical_events": "event_id string, session_id string, name string, start_time double, end_time double",
    "data_files": "file_id string, session_id string, signal_id string, path string, format string, role string, checksum string, processing_run_id string",
    "processing_runs": "processing_run_id string, kind string, name string, status string, input_file_ids array<string>, parameters string, started_at double",
    "derived_features": "feature_id string, processing_run_id string, signal_ids array<string>, name string, value double, unit string, start_time double, end_time double",
    "quality_annotations": "annotation_id string, target_type string, target_id string, name string, passed boolean, severity string, start_time double, end_time double",
}
KEYS = {t: ddl.split()[0] for t, ddl in TABLES.items()}
REFERENCES = (
    ("sessions", "case_id", "cases"),
    ("signal_streams", "session_id", "sessions"),
    ("signal_streams", "device_id", "devices"),
    ("eit_configurations", "signal_id", "signal_streams"),
    ("emg_channels", "signal_id", "signal_streams"),
    ("ventilator_settings", "session_id", "sessions"),
    ("ventilator_settings", "device_id", "devices"),
    ("breaths", "session_id", "sessions"),
    ("breaths", "signal_id", "signal_streams"),
    ("clinical_events", "session_id", "sessions"),
    ("data_files", "session_id", "sessions"),
    ("data_files", "signal_id", "signal_streams"),
    ("derived_features", "processing_run_id", "processing_runs"),
)
ARRAY_REFERENCES = (("processing_runs", "input_file_ids", "data_files"), ("derived_features", "signal_ids", "signal_streams"))
TARGETS = {"signal": "signal_streams", "file": "data_files", "session": "sessions", "event": "clinical_events", "feature": "derived_features"}
FORMATS = {"h5": "hdf5", "hdf5": "hdf5", "edf": "edf", "csv": "csv", "json": "json", "mat": "mat", "parquet": "parquet", "zarr": "zarr"}


class Store:
    """Thirteen lazy tables; ``add`` appends rows by column name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables = {t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def add(self, table: str, rows: DataFrame) -> None:
        """Append; columns that the table lacks are left out, a key that is there stays as it is."""
        schema = self.tables[table].schema
        there = set(rows.columns)
        same = rows.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        key = KEYS[table]
        self.tables[table] = self.tables[table].unionByName(same.dropDuplicates([key]).join(self.tables[table].select(key), key, "left_anti").select(*schema.names))

    # lookups

    def sessions_for_case(self, case_id: str) -> DataFrame:
        return self["sessions"].where(F.col("case_id") == case_id)

    def streams_for_session(self, session_id: str) -> DataFrame:
        return self["signal_streams"].where(F.col("session_id") == session_id)

    def files_for_signal(self, signal_id: str) -> DataFrame:
        return self["data_files"].where(F.col("signal_id") == signal_id)

    def runs_for_file(self, file_id: str) -> DataFrame:
        return self["processing_runs"].where(F.array_contains("input_file_ids", file_id))

    def features_for_run(self, run_id: str) -> DataFrame:
        return self["derived_features"].where(F.col("processing_run_id") == run_id)

    def annotations_for_target(self, kind: str, target_id: str) -> DataFrame:
        return self["quality_annotations"].where((F.col("target_type") == kind) & (F.col("target_id") == target_id))

    # checks

    def validate(self, complete: bool = False) -> DataFrame:
        """(rule, violations) of references, time windows and, if asked, completeness."""
        parts = [validation.check_references({f"{c}.{k}": (self[c], k, self[p], KEYS[p]) for c, k, p in REFERENCES})]
        parts += [validation._count(validation.array_orphans(self[c], k, self[p], KEYS[p]), f"{c}.{k}") for c, k, p in ARRAY_REFERENCES]
        parents = {kind: (self[t], KEYS[t]) for kind, t in TARGETS.items()}
        parts.append(validation._count(validation.polymorphic_orphans(self["quality_annotations"], "target_type", "target_id", parents), "quality_annotations.target_id"))
        parts.append(validation.check_time_windows({f"{t} ends before it starts": (self[t], "start_time", "end_time") for t in ("derived_features", "clinical_events", "quality_annotations", "breaths")}))
        if complete:
            parts.append(validation.check_complete(self["signal_streams"], ["unit", "fs", "start_time"], "signal_streams."))
            parts.append(validation.check_complete(self["data_files"], ["checksum", "format"], "data_files."))
            derived = self["data_files"].where("role IN ('processed', 'derived')")
            parts.append(validation.check_condition(derived, "derived files have a run", F.col("processing_run_id").isNotNull()))
            parts.append(validation.check_condition(self["processing_runs"].where("status = 'succeeded'"), "runs have inputs", F.size("input_file_ids") > 0))
            parts.append(validation.check_condition(self["clinical_events"], "events have a start", F.col("start_time").isNotNull()))
            parts.append(validation.check_condition(self["derived_features"], "features have a signal", F.size("signal_ids") > 0))
        return reduce(DataFrame.unionByName, parts)

    def export(self, out: str, form: str = "json", check: bool = True, complete: bool = False) -> str:
        """Write all tables; ValueError lists broken rules first."""
        if check:
            broken = [f"{r.rule}: {r.violations}" for r in self.validate(complete).where("violations > 0").collect()]
            if broken:
                raise ValueError("; ".join(broken))
        return export.write_tables(self.tables, out, form)

    # recorders

    def record_signals(self, signals: DataFrame, session_id: str) -> None:
        """signals (modality, category, channel, unit, fs, ...) as streams, names normalised."""
        made = signals.withColumns({"session_id": F.lit(session_id), "category": categories.column(F.col("category")), "unit": units.column(F.col("unit"))})
        self.add("signal_streams", made.withColumn("signal_id", stable_id(F.lit(session_id), F.col("modality"), F.col("channel"))))

    def record_files(self, files: DataFrame, session_id: str, role: str = "raw") -> None:
        """files (path, checksum) with a format by suffix."""
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
        self.add("data_files", files.withColumns({"session_id": F.lit(session_id), "role": F.lit(role), "format": F.coalesce(F.try_element_at(known, suffix), suffix), "file_id": stable_id(F.lit(session_id), F.col("path"))}))

    def record_run(self, kind: str, name: str, status: str = "succeeded", parameters: str = "{}", inputs: list[str] | None = None) -> str:
        """A processing run (kind: step, session_action or workflow); gives its id."""
        row = self.spark.createDataFrame([(kind, name, status, inputs or [], parameters)], "kind string, name string, status string, input_file_ids array<string>, parameters string")
        row = row.withColumn("processing_run_id", stable_id(F.col("kind"), F.col("name"), F.col("parameters")))
        self.add("processing_runs", row)
        return row.first().processing_run_id

    def record_parameters(self, values: DataFrame, run_id: str, signal_ids: list[str]) -> None:
        """(name, value, unit?, start_time?, end_time?) as derived features."""
        made = values.withColumns({"processing_run_id": F.lit(run_id), "signal_ids": F.array(*[F.lit(s) for s in signal_ids]).cast("array<string>")})
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "start_time", "end_time") if c in values.columns]
        self.add("derived_features", made.withColumn("feature_id", stable_id(F.lit(run_id), *parts)))

    def record_flags(self, flags: DataFrame, target_type: str, target_id: str) -> None:
        """Quality flags (name, passed, severity?) of one target as annotations."""
        made = flags.withColumns({"target_type": F.lit(target_type), "target_id": F.lit(target_id)})
        self.add("quality_annotations", made.withColumn("annotation_id", stable_id(F.lit(target_type), F.lit(target_id), F.col("name"))))

    def record_synchronization(self, clock: DataFrame) -> None:
        """Copy sync_method and start times (in ms) of (modality, start_time, sync_method) to the streams."""
        c = clock.select("modality", (F.col("start_time") * 1000).alias("_ms"), F.col("sync_method").alias("_method"))
        joined = self["signal_streams"].join(c, "modality", "left")
        joined = joined.withColumn("time_offset_ms", F.coalesce("_ms", "time_offset_ms")).withColumn("sync_method", F.coalesce("_method", "sync_method"))
        self.tables["signal_streams"] = joined.select(*self.tables["signal_streams"].columns)
