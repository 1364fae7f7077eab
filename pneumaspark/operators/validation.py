"""Integrity queries: one row per rule with the number of rows that break it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key isn't in ``parent``."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def array_orphans(child: DataFrame, keys: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows (with ``_ref``) for each element of an array of keys that isn't in ``parent``."""
    return orphans(child.withColumn("_ref", F.explode(keys)), "_ref", parent, parent_key)


def polymorphic_orphans(child: DataFrame, kind: str, key: str, parents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose (kind, key) is in none of the parents."""
    known = reduce(DataFrame.unionByName, [p.select(F.lit(k).alias(kind), F.col(c).cast("string").alias(key)) for k, (p, c) in parents.items()])
    return child.withColumn(key, F.col(key).cast("string")).join(known.distinct(), [kind, key], "left_anti")


def check_references(rules: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, violations) of foreign keys: rule -> (child, key, parent, parent key)."""
    return reduce(DataFrame.unionByName, [_count(orphans(*r), name) for name, r in rules.items()])


def check_time_windows(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(rule, violations): rows that end before they start."""
    return reduce(DataFrame.unionByName, [_count(df.where(F.col(end) < F.col(start)), name) for name, (df, start, end) in tables.items()])


def check_complete(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """(rule, violations): null values in each column, in one pass."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(f"{prefix}{c} present").alias("rule"), F.col(c).alias("violations")) for c in columns])
    return totals.select(F.explode(pairs).alias("p")).select("p.rule", "p.violations")


def check_condition(df: DataFrame, rule: str, holds: Column) -> DataFrame:
    """(rule, violations): rows for which a condition is false or null."""
    return _count(df.where(~F.coalesce(holds, F.lit(False))), rule)
