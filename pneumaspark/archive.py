"""Results of any shape as tables: scalars in their rows, arrays beside them under keys.

``write`` makes two Parquet tables in a folder, both written by executors: ``rows``, where an array is
null and its key, index, shape and kind of number stand instead, and ``arrays`` with the values, flat.
``read`` puts them together again.  A key is the result's name, cleaned to letters, digits and underscores, and
the number of its occurrence; results that have one array for each interval share a key and count by ``index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from pneumaspark.session import materialize

ARRAYS = "array_key string, array_index long, shape array<long>, values array<double>"


def clean(name: Column) -> Column:
    """A name as part of a key; "result" if nothing is left of it."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.when(kept == "", "result").otherwise(kept)


def numbered(rows: DataFrame, name: str, counts: Column) -> DataFrame:
    """Rows with ``nth``, the number among those that count with an equal cleaned name, from 0 in the order they come.

    Counted in two levels, within a partition and over the partitions' counts, so that a name that most rows have is no task's alone.
    """
    base = rows.withColumns({"_row": F.monotonically_increasing_id(), "_base": clean(F.col(name)), "_counts": F.coalesce(counts, F.lit(False)).cast("int")})
    placed = materialize(base, "results").withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy("_name").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col("_base").alias("_name"), F.col("_part").alias("_of")).agg(F.sum("_counts").alias("_n"))
    starts = sums.select("_name", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.sum("_counts").over(Window.partitionBy("_base", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_counts")
    joined = placed.withColumn("_within", within).join(starts, (F.col("_base") == F.col("_name")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("nth", (F.col("_within") + F.col("_start")).cast("long")).drop("_row", "_part", "_within", "_name", "_of", "_start", "_base", "_counts")


def _shape(c: Column, kind: DataType) -> tuple[Column, Column, str]:
    """(shape, flat doubles, kind of number) of a one- or two-dimensional array; rows of a grid are as long as the first."""
    inner = kind.elementType
    if isinstance(inner, ArrayType):
        size = F.array(F.size(c).cast("long"), F.coalesce(F.size(F.get(c, F.lit(0))), F.lit(0)).cast("long"))
        return size, F.flatten(c).cast("array<double>"), inner.elementType.simpleString()
    return F.array(F.size(c).cast("long")), c.cast("array<double>"), inner.simpleString()


def write(results: DataFrame, out: str, name: str = "name", columns: Sequence[str] = ("values",), index: str | None = None) -> str:
    """Write ``results``, whose ``columns`` are arrays of numbers or null, under ``out``.

    ``index``: a column of whole numbers from 0 that counts the arrays of a result with one for each interval; rows that share
    a name then share a key.  Without it each row has a key of its own.
    """
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    rows = results.withColumn("nth", F.lit(0).cast("long")) if index else numbered(results, name, some)
    key = F.concat_ws("_", clean(F.col(name)), F.col("nth").cast("string"))
    at = F.col(index).cast("long") if index else F.lit(0).cast("long")
    parts = []
    for c in columns:
        kind = results.schema[c].dataType
        if not isinstance(kind, ArrayType):
            raise ValueError(f"column {c!r} doesn't hold arrays")
        shape, flat, number = _shape(F.col(c), kind)
        own = key if c == columns[0] else F.concat_ws("_", key, F.lit(c))
        there = F.col(c).isNotNull()
        parts.append(rows.where(there).select(own.alias("array_key"), at.alias("array_index"), shape.alias("shape"), flat.alias("values")))
        rows = rows.withColumns({f"{c}_key": F.when(there, own), f"{c}_index": F.when(there, at), f"{c}_shape": F.when(there, shape), f"{c}_type": F.when(there, F.lit(number))})
    arrays = parts[0]
    for p in parts[1:]:
        arrays = arrays.unionByName(p)
    rows.drop("nth", *columns).write.parquet(f"{out}/rows")
    arrays.repartitionByRange("array_key", "array_index").sortWithinPartitions("array_key", "array_index").write.parquet(f"{out}/arrays")
    return out


def _grid(flat: Column, shape: Column) -> Column:
    height, width = F.get(shape, F.lit(0)), F.get(shape, F.lit(1)).cast("int")
    lines = F.transform(F.sequence(F.lit(0).cast("long"), height - 1), lambda k: F.slice(flat, k.cast("int") * width + 1, width))
    return F.when(height == 0, F.array().cast("array<array<double>>")).otherwise(lines)


def read(spark: SparkSession, out: str, columns: Sequence[str] = ("values",), grids: Sequence[str] = ()) -> DataFrame:
    """The results that ``write`` wrote: arrays of doubles in their columns, two-dimensional ones for ``grids``."""
    rows, arrays = spark.read.parquet(f"{out}/rows"), spark.read.schema(ARRAYS).parquet(f"{out}/arrays")
    for c in columns:
        own = arrays.select(F.col("array_key").alias(f"{c}_key"), F.col("array_index").alias(f"{c}_index"), F.col("values").alias(c))
        rows = rows.join(own, [f"{c}_key", f"{c}_index"], "left")
        if c in grids:
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), _grid(F.col(c), F.col(f"{c}_shape"))))
        rows = rows.drop(f"{c}_key", f"{c}_index", f"{c}_shape", f"{c}_type")
    return rows
