"""Importance resampling towards a target: hashed features, integer scores, an exact draw.

1. every document's features (runs of up to ``max_run`` words) are counted by
   bucket, one array of counts for each task, and so are the target's;
2. a bucket's gain is the floored log ratio of the two smoothed shares; the table
   of gains has ``n_buckets`` entries, whatever the size of the corpus;
3. a document's weight is the floored mean of its features' gains, taken from
   that array, and its score the weight plus Gumbel noise from its id;
4. scores are integers, so a histogram of them is exact: suffix sums give the
   number of documents above each score, hence the cutoff, and ranks are those
   offsets plus ``row_number`` by doc_id within a score.

The histogram is small for any corpus: gains lie within 1000 * ln of the largest
count, about +-44,000, and noise between -3,200 and 23,000.  Within a score,
documents are numbered in blocks of doc_id, whose counts are summed first, so a
score that many documents share is no single task's.

Null and empty texts have no features, weight 0 and aren't drawn; repeated rows
count and are drawn each, rows of one doc_id, score and number of features in any
order.  A null doc_id hashes as the empty string and comes first among ties.  An
empty table gives no rows; an empty target gives smoothed gains.  Other columns of
the tables are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.llm.common import arrow_schema, blocks, id_text, map_docs, record_batch, small
from pneumaspark.session import materialize

BUCKETS, MAX_RUN, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Blocks of doc_id in which the documents of one score are numbered.
ID_BLOCKS = 64

_KEEP = string.ascii_lowercase.encode() + string.digits.encode()
_SPACED = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WEIGHED = "doc_id long, n_features long, weight long, score long"


def feature_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.translate(_SPACED).split() if text else []


class Buckets:
    """Buckets of a text's features; each distinct word is hashed once a worker."""

    _made: dict[tuple, "Buckets"] = {}

    def __init__(self, n_buckets: int, max_run: int, most: int = 500_000):
        self.n, self.max_run, self.most = n_buckets, max_run, most
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, n_buckets: int, max_run: int) -> "Buckets":
        key = n_buckets, max_run
        if key not in cls._made:
            cls._made[key] = cls(n_buckets, max_run)
        return cls._made[key]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words, known = feature_words(text), self.words
        try:
            packed = b"".join(map(known.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in known}
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(words)
            known.update((w, (zlib.crc32(w) % self.n).to_bytes(4, "little")) for w in new)
            packed = b"".join(map(known.__getitem__, words))
        singles = np.frombuffer(packed, "<u4")
        runs = [[zlib.crc32(b" ".join(words[k : k + n])) % self.n for k in range(len(words) - n + 1)] for n in range(2, self.max_run + 1)]
        return np.concatenate([singles, *(np.array(r, "<u4") for r in runs)]) if runs else singles


def bucket_counts(docs: DataFrame, n_buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """(bucket, n): features of all rows by bucket; a task sends one count for each bucket."""
    schema = arrow_schema("bucket int, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets.of(n_buckets, max_run), np.zeros(n_buckets, np.int64)
        for _, texts in blocks(batches, 4 << 20):
            total += np.bincount(np.concatenate([buckets(t) for t in texts]), minlength=n_buckets)
        on = np.flatnonzero(total)
        yield record_batch({"bucket": on, "n": total[on]}, schema)

    return id_text(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """Floored log ratio of a bucket's smoothed share in ``target`` and in ``docs``, times 1000: ``n_buckets`` integers."""
    sides = bucket_counts(docs, n_buckets, max_run).withColumn("side", F.lit(0)).union(bucket_counts(target, n_buckets, max_run).withColumn("side", F.lit(1)))
    found = sides.toPandas()  # at most two rows for each bucket
    counts = np.zeros((2, n_buckets))
    counts[found["side"], found["bucket"]] = found["n"]
    all_s, all_t = counts.sum(axis=1) + n_buckets
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in counts.T.tolist()], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise, times 1000 and floored, from the hash of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words) of every row, by array look-ups."""
    n_buckets = len(gain)

    def per_block(ids: list, texts: list) -> dict:
        found = [Buckets.of(n_buckets, max_run)(t) for t in texts]
        sizes = [len(b) for b in found]
        weights = [int(gain[b].sum()) // n if n else 0 for b, n in zip(found, sizes, strict=True)]
        # n words make n + (n - 1) + ... features, so one word and more follow from the number alone when runs are single words
        n_words = sizes if max_run == 1 else [len(feature_words(t)) for t in texts]
        return {"doc_id": ids, "n_features": sizes, "weight": weights, "score": [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)], "n_words": n_words}

    return map_docs(docs, per_block, WEIGHED + ", n_words long")


def rank_offsets(histogram: DataFrame, percent: int) -> DataFrame:
    """(score, above, drawn): documents above each surviving score, and how many are drawn in all.

    ``histogram`` has (score, n), a row for each distinct integer score: see the module's bound.
    """
    by_score = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    every = Window.partitionBy(F.lit(0))
    h = histogram.select("score", (F.sum("n").over(by_score) - F.col("n")).alias("above"), F.sum("n").over(every).alias("all"))
    return h.select("score", "above", F.expr(f"{percent} * all div 100").alias("drawn")).where("above < drawn")


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Rank the documents drawn: (doc_id, n_features, weight, score, rank), rank null for all others.

    ``weighed`` is a written table; it is read for the histogram, for the counts of
    blocks within surviving scores and for the result.
    """
    open_to = F.col("n_words") >= least_words
    cut = materialize(rank_offsets(weighed.where(open_to).groupBy("score").agg(F.count(F.lit(1)).alias("n")), percent), "score_ranks")
    ids = weighed.where(open_to).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, width = ids.lo or 0, ((ids.hi or 0) - (ids.lo or 0)) // ID_BLOCKS + 1
    # the histogram's rows are bounded by the range of scores, so they go to every task
    placed = weighed.withColumn("_open", open_to).join(F.broadcast(cut), "score", "left").withColumn("_block", F.coalesce(F.expr(f"(doc_id - {lo}) div {width}"), F.lit(-1)))
    drawn = placed.where(F.col("_open") & F.col("above").isNotNull())
    before = Window.partitionBy("score").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy("score", "above", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = materialize(starts.select("score", "_block", (F.col("above") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_start")), "block_ranks")
    nth = F.row_number().over(Window.partitionBy("score", "_block").orderBy(F.asc_nulls_first("doc_id"), "n_features"))
    ranked = drawn.join(small(starts), ["score", "_block"]).withColumn("_rank", F.col("_start") + nth)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("_rank") <= F.col("drawn"), F.col("_rank")).cast("long").alias("rank"))
    rest = placed.where(~F.col("_open") | F.col("above").isNull()).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document's weight, score and rank in a draw of ``percent`` hundredths towards ``target``."""
    target = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(docs, target, n_buckets, max_run)
    return draw(materialize(weigh(docs, gain, max_run, seed), "weighed"), least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns; ids are expected to be unique here."""
    chosen = resample(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi").select(*docs.columns)
