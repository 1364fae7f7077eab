"""Benchmark decontamination over a positional inverted index.

Only DataFrame functions run here.  The steps:

1. ``build_index`` cuts the training texts into words once and stores the
   postings (term, document, position) of every term that the test set has.  The
   index is split by documents, as search engines do: each task sorts and writes
   the postings of the documents it read, so building it shuffles nothing.
2. ``anchors`` picks for every window of every item its two rarest terms, by the
   index's own counts over all documents.
3. ``candidates`` reads the postings of those terms, subtracts each term's offset
   in its item, and intersects the lists: a (document, item, diagonal) stays only
   where two terms agree on it.
4. ``exact_matches`` compares the words along each diagonal with the item's;
   runs of equal words that hold a whole window are hits.

``proximity_matches`` intersects the same lists with a tolerance instead; ``proximity_report``
gives them for each document, and ``drop_contaminated`` acts on those with at least
``NEAR_LEAST`` anchors and ``NEAR_SHARE`` of the item's.

Words are runs of bytes other than ASCII controls, blanks and punctuation, after
A-Z is lower-cased; other letters keep their case.  Null and empty texts have no
words; items without words match nothing.  Rows that repeat a (doc_id, text) get
equal results.  Extra columns of either table are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pneumaspark.llm.common import small
from pneumaspark.session import materialize

WINDOW = 10
#: Anchors that a proximity match needs to drop a document, and their share of the item's.
NEAR_LEAST, NEAR_SHARE = 5, 0.5
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, _SEPARATOR, -1), "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that tells rows apart that share a doc_id."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))


def test_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words) of the items that have words, rows that repeat taken once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    return items.where(F.size("words") > 0).distinct().select("item_id", F.xxhash64("item_id", "words").alias("item"), F.size("words").alias("n"), "words")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Written postings (term_id, key, pos) of the terms (term, term_id) in all documents."""
    postings = (
        keyed(docs)
        .select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
        .join(small(terms), "term")
        .select("term_id", "key", "pos")
    )
    return materialize(postings.sortWithinPartitions("term_id", "key", "pos"), "postings")


def anchors(items: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(term_id, item, offset): the two rarest terms of every window, by their postings."""
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    placed = (
        items.select("item", "n", F.posexplode("words").alias("offset", "term"))
        .join(terms, "term")
        .join(counts, "term_id", "left")
        .select("item", "n", "offset", "term_id", F.coalesce("df", F.lit(0)).alias("df"))
    )
    last = F.greatest(F.col("n") - WINDOW, F.lit(0))
    first_window = F.greatest(F.col("offset") - (WINDOW - 1), F.lit(0))
    in_windows = placed.withColumn("window", F.explode(F.sequence(first_window, F.least(F.col("offset"), last))))
    by_window = Window.partitionBy("item", "window")
    ranked = in_windows.withColumn("least", F.min("df").over(by_window)).withColumn("rank", F.row_number().over(by_window.orderBy("df", "offset")))
    return ranked.where("least > 0 AND rank <= 2").select("term_id", "item", "offset", F.least("n", F.lit(2)).alias("need")).distinct()


def candidates(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(key, item, diagonal) where the lists of at least two anchors meet."""
    lists = index.join(small(anchor), "term_id").select("key", "item", "need", "offset", (F.col("pos") - F.col("offset")).alias("diagonal"))
    met = lists.groupBy("key", "item", "diagonal", "need").agg(F.min("offset").alias("a"), F.max("offset").alias("b"))
    return met.where((F.col("need") < 2) | (F.col("a") < F.col("b"))).select("key", "item", "diagonal")


def exact_matches(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(key, item_id, start, length): runs of words equal to an item's that hold a whole window."""
    lined = found.groupBy("key").agg(F.collect_list(F.struct("item", "diagonal")).alias("lines"))
    lined = materialize(lined, "diagonals")
    rows = keyed(docs).join(small(lined), "key").select("key", words(F.col("text")).alias("doc_words"), F.explode("lines").alias("at"))
    rows = rows.join(small(items), rows["at.item"] == items["item"])
    rows = rows.select("key", "doc_words", F.struct("item_id", "at.diagonal", F.col("words").alias("item_words")).alias("line"))
    offset_equal = F.expr("transform(line.item_words, (w, i) -> get(doc_words, line.diagonal + i) <=> w)")
    need = F.least(F.lit(WINDOW), F.size("line.item_words"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("line.item_words") - need),
        lambda s: F.forall(F.slice(F.col("equal"), s + 1, F.col("need")), lambda e: e),
    )
    hits = rows.select("key", "line", offset_equal.alias("equal"), need.alias("need")).select("key", "line", "need", F.explode(starts).alias("s"))
    return hits.select("key", F.col("line.item_id").alias("item_id"), (F.col("line.diagonal") + F.col("s")).alias("start"), F.col("need").alias("length")).distinct()


def proximity_matches(index: DataFrame, anchor: DataFrame, slop: int = 3) -> DataFrame:
    """(key, item, near): anchors of an item that lie within ``slop`` words of one diagonal.

    ``near`` is the most distinct anchors on one band of diagonals; bands overlap
    by half, so two anchors at most ``slop`` apart always share one.
    """
    lists = index.join(small(anchor), "term_id").select("key", "item", "offset", (F.col("pos") - F.col("offset")).alias("d"))
    width = 2 * max(1, slop)
    bands = lists.select("key", "item", "offset", F.explode(F.array(F.floor(F.col("d") / width) * 2, F.floor((F.col("d") + slop) / width) * 2 + 1)).alias("band"))
    near = bands.distinct().groupBy("key", "item", "band").agg(F.count(F.lit(1)).alias("near")).where("near >= 2")
    return near.groupBy("key", "item").agg(F.max("near").alias("near"))


def prepared(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written items, index and anchors, which exact and proximity matches share."""
    items = materialize(test_words(benchmark), "items")
    terms = materialize(items.select(F.explode("words").alias("term")).distinct().select("term", F.xxhash64("term").alias("term_id")), "terms")
    index = build_index(docs, terms)
    return items, index, materialize(anchors(items, terms, index), "anchors")


def supported(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(key, item, near, n_anchors): the proximity matches with enough anchors, also of the item's."""
    sizes = anchor.groupBy("item").agg(F.countDistinct("offset").alias("n_anchors"))
    near = proximity_matches(index, anchor).where(F.col("near") >= NEAR_LEAST).join(small(materialize(sizes, "anchor_counts")), "item")
    return near.where(F.col("near") >= NEAR_SHARE * F.col("n_anchors"))


def proximity_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, near, n_anchors): documents and the items that they match nearly, with enough anchors."""
    items, index, anchor = prepared(docs, benchmark)
    found = materialize(supported(index, anchor), "near")
    return keyed(docs).select("doc_id", "key").join(small(found), "key").join(small(items.select("item", "item_id")), "item").select("doc_id", "key", "item_id", "near", "n_anchors")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated."""
    return exact_report(docs, *prepared(docs, benchmark))


def exact_report(docs: DataFrame, items: DataFrame, index: DataFrame, anchor: DataFrame) -> DataFrame:
    """What ``contamination`` gives, from what ``prepared`` gives."""
    found = materialize(candidates(index, anchor), "candidates")
    hits = exact_matches(docs, items, found)
    spans = hits.groupBy("key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + length - 1)"))))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item_id")).alias("ids"),
    )
    hit = materialize(spans, "hits")
    size = keyed(docs).select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return size.join(small(hit), "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of any item and matches none nearly."""
    items, index, anchor = prepared(docs, benchmark)
    exact = exact_report(docs, items, index, anchor).where("contaminated").select("key")
    hit = materialize(exact.unionByName(supported(index, anchor).select("key")).distinct(), "contaminated")
    hit = small(hit)
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(hit, key == hit["key"], "left_anti")
