"""Exact token-length histogram and what follows from its suffix sums.

Documents are aggregated by encoded length; that histogram, whose rows are the
distinct lengths, answers totals, quantiles and truncated totals for every
context limit without another look at the corpus.

Null and empty texts have length 0.  Repeated rows count each time.  An empty
table gives an empty histogram.  Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.llm.common import WordEncoder, map_docs

BLOCK = 4096


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document."""

    def lengths(ids: list, texts: list) -> dict:
        encode = WordEncoder.of(tokenizer).encode
        return {"doc_id": ids, "n_tokens": [len(encode(t)) // 4 for t in texts]}

    return map_docs(docs, lengths, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length; partial sums are taken before the shuffle."""
    return token_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits_table(histogram: DataFrame) -> DataFrame:
    """The histogram with its running and suffix sums, for a context limit of each length.

    Columns: n_tokens, n_docs, docs_le, docs_gt, tokens_le, tokens_gt,
    tokens_truncated (tokens kept when every document is cut at this length),
    tokens_lost (those cut away), quantile (share of documents this long at most).

    Sums run in two levels: within a block of lengths, and over the blocks'
    totals, so no task ever holds all lengths.
    """
    h = histogram.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    per_block = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    per_block = per_block.select(
        "block",
        F.coalesce(F.sum("b_docs").over(before), F.lit(0)).alias("o_docs"),
        F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("o_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    run = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    le_docs = F.col("o_docs") + F.col("r_docs")
    le_tokens = F.col("o_tokens") + F.col("r_tokens")
    over = F.col("all_docs") - le_docs
    return (
        h.withColumn("r_docs", F.sum("n_docs").over(run))
        .withColumn("r_tokens", F.sum(tokens).over(run))
        .join(per_block, "block")
        .select(
            "n_tokens",
            "n_docs",
            le_docs.alias("docs_le"),
            over.alias("docs_gt"),
            le_tokens.alias("tokens_le"),
            (F.col("all_tokens") - le_tokens).alias("tokens_gt"),
            (le_tokens + over * F.col("n_tokens")).alias("tokens_truncated"),
            (F.col("all_tokens") - le_tokens - over * F.col("n_tokens")).alias("tokens_lost"),
            (le_docs / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """Totals for any one limit, whether or not a document has that length: one row.

    Columns: context_limit, n_docs, n_truncated, tokens_total, tokens_kept.
    """
    n, w = F.col("n_tokens"), F.col("n_docs")
    none: Column = F.lit(0).cast("long")
    return limits.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(w), none).alias("n_docs"),
        F.coalesce(F.sum(F.when(n > limit, w)), none).alias("n_truncated"),
        F.coalesce(F.sum(n * w), none).alias("tokens_total"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * w), none).alias("tokens_kept"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents doesn't exceed: one row, null for no documents."""
    return limits.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
