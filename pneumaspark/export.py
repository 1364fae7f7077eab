"""Sinks: tables as Parquet, CSV or JSON, scalars and JSON files, and row shapes for exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.sources import storage


def write_tables(tables: dict[str, DataFrame], out: str, form: str = "parquet") -> str:
    """Each table in a folder of its own.  CSV and JSON hold arrays and structs as JSON text."""
    for name, df in tables.items():
        if form == "csv":
            nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
            df.withColumns(nested).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        elif form in ("parquet", "json"):
            df.write.mode("overwrite").format(form).save(f"{out}/{name}")
        else:
            raise ValueError(f"unknown form {form!r}")
    return out


def write_scalar(value: float, path: str, precision: int = 8) -> str:
    """One number as text with fixed decimals, on the driver."""
    return _write(f"{float(value):.{precision}f}\n", path)


def write_json(payload, path: str) -> str:
    return _write(json.dumps(payload, indent=2, ensure_ascii=False, default=str), path)


def _write(text: str, path: str) -> str:
    """A small file on the file system that the path names, beside the tables that Spark writes there."""
    system, inner, _ = storage.opened(path)
    system.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(text.encode())
    return path


def parameters_to_rows(parameters: DataFrame) -> DataFrame:
    """(modality, values map) to long rows (modality, name, value)."""
    return parameters.select("modality", F.explode("values").alias("name", "value"))


def links_to_rows(links: DataFrame, modalities: list[str]) -> DataFrame:
    """Links with ``modalities``: the names of those present, joined by a plus sign."""
    present = F.concat_ws("+", *[F.when(F.col(f"t_{m}").isNotNull(), F.lit(m)) for m in modalities])
    return links.withColumn("modalities", present)


def interval_rows(breaths: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """One row per interval with its value or array, and the array's size."""
    out = breaths.join(values, on, "left")
    arrays = [c for c, t in values.dtypes if t.startswith("array")]
    return out.withColumns({f"{c}_size": F.size(c) for c in arrays})


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Tables one after another; the columns are all that occur, in the order first seen."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
