"""A corpus pipeline: quality, lines, near-duplicates, benchmark passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.

A stage's result reads tables that the stage has written on its way.  They are dropped when
the next stage of the session begins, as by then the result has been written itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pneumaspark.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from pneumaspark.session import drop_tables, materialize, scratch, table

#: SQL can't tokenize, pack or follow components; the stages have brute-force tests instead.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the stage that ran last, by application.
_LEFT: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    """A stage that begins by dropping the tables of the one before."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        drop_tables(spark, _LEFT.pop(session, []))
        with scratch() as made:
            out = f(spark, docs, sf_dir)
        _LEFT[session] = made
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts have no words and go with them."""
    return quality.keep_good(docs)


@stage
def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so does a document of which no line with a word stays.  n_chars follows the text; null texts stay."""
    return line_dedup.strip_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; texts without words and rows with a null doc_id all stay."""
    return jaccard_join.keep_one(docs)


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; a null text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_templates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = materialize(f(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
