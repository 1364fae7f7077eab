"""Arrays beside their rows: what is written comes back."""

import pytest
from pyspark.sql import functions as F

from pneumaspark import archive


def test_results_come_back(spark, tmp_path):
    rows = [("rate", 12.5, None, None, {"u": "1/min"}), ("tiv", None, [1.0, None, 3.0], [0.0, 0.5, 1.0], {}), ("tiv", None, [], None, None), ("tiv", 2.0, None, None, {}), ("_map (a)", None, [4.0], None, {}), (None, None, [7.0], None, {})]
    results = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "name string, value double, values array<double>, time array<double>, metadata map<string,string>, at int").repartition(3, "at")
    out = archive.write(results, f"{tmp_path}/a", columns=("values", "time"))
    table = {r["at"]: r for r in spark.read.parquet(f"{out}/rows").collect()}
    assert table[0].values_key is None and table[0].value == 12.5 and "values" not in spark.read.parquet(f"{out}/rows").columns
    assert {table[1].values_key, table[2].values_key} == {"tiv_0", "tiv_1"} and table[4].values_key == "map_a_0" and table[5].values_key == "result_0" and table[3].values_key is None
    assert table[1].time_key == f"{table[1].values_key}_time" and table[1].values_shape == [3] and table[1].values_type == "double"
    back = archive.read(spark, out, ("values", "time"))
    assert set(back.columns) == set(results.columns)
    assert {r["at"]: (r.name, r.value, r["values"], r.time, r.metadata) for r in back.collect()} == dict(enumerate(rows))


def test_grids_of_intervals(spark, tmp_path):
    grid = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (F.col("id") * 100 + i * 10 + j).cast("float")))
    results = spark.range(40).select((F.col("id") % 2).cast("string").alias("label"), F.expr("id div 2").alias("breath_no"), F.when(F.col("id") != 7, grid).alias("map"))
    out = archive.write(results, f"{tmp_path}/b", "label", ("map",), "breath_no")
    arrays = spark.read.parquet(f"{out}/arrays")
    assert {tuple(r.shape) for r in arrays.select("shape").distinct().collect()} == {(3, 5)} and arrays.select("array_key").distinct().count() == 2 and arrays.count() == 39
    back = {(r.label, r.breath_no): r.map for r in archive.read(spark, out, ("map",), ("map",)).collect()}
    assert back == {(r.label, r.breath_no): r.map for r in results.collect()}
    with pytest.raises(ValueError):
        archive.write(results, f"{tmp_path}/c", "label", ("breath_no",))


def test_a_name_that_all_rows_have(spark):
    rows = spark.range(500).selectExpr("'same' AS name", "id").repartition(7)
    found = archive.numbered(rows, "name", F.col("id") % 5 > 0).where("id % 5 > 0").collect()
    assert sorted(r.nth for r in found) == list(range(400))
