"""Line deduplication by a log-template tree of fixed depth.

Only DataFrame functions run here.  A line's tokens are what single spaces
separate once its ends are trimmed; a token with a digit is a variable field and
becomes ``<*>``, if another token of the line has a letter: a row of numbers or a rule of
dashes is no template of anything but itself.  The tree sends a line down by its token count and its first
``DEPTH`` tokens to a leaf.  Within a leaf, a position is constant if one token
stands there in more than half of the leaf's distinct lines; other positions are
variable fields.  A line belongs to its leaf's template if it agrees with the
constants in at least ``SIMILARITY`` of its tokens, else it is a template alone.

A leaf can hold several templates, or one among lines that have nothing in common, and
then no majority shows them.  So a line also belongs to templates with one variable
field: the line without a run of tokens, at most ``1 - SIMILARITY`` of all, behind the
first ``DEPTH``.  All lines that share such a rest have one template, whatever else
stands in their leaf.  Lines of ``LONG_LINE`` tokens or more go from the second document on.
``dedup_report`` does neither, since its SQL twin states one template for each leaf and
three documents for all.

A template that occurs in ``MIN_DOCS`` documents or more is dropped from all of
them but the one with the smallest doc_id.  Lines without a word stay.

Null text stays null and has no lines; empty text has one empty line.  Rows that
repeat a (doc_id, text) count as one document and are treated alike.  A null
doc_id never counts as the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import small
from pneumaspark.session import materialize

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
#: Lines of so many tokens go from the second document on, since chance doesn't repeat them.
LONG_LINE = 10
VARIABLE = "<*>"
#: A token with a digit, and what a constant token has to have.
FIELD, LETTER = "[^ ]*[0-9][^ ]*", r"\p{L}"
BLANKS = " \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    """The line without blanks (space, tab to carriage return) at its ends."""
    return F.btrim(line, F.lit(BLANKS))


def fieldless(line: Column) -> Column:
    """Whether a trimmed line has no constant token with a letter, as rows of numbers and rules of dashes have none."""
    return F.when(line.rlike("[0-9]"), ~F.regexp_replace(line, FIELD, "").rlike(LETTER)).otherwise(~line.rlike(LETTER))


def masked(line: Column) -> Column:
    """The line with its variable fields generalised; a line without a constant token stays as it is."""
    line = trimmed(line)
    return F.when(line.rlike("[0-9]") & ~fieldless(line), F.regexp_replace(line, FIELD, VARIABLE)).otherwise(line)


def tree_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at, masked, line, n_tokens, leaf): every line with a word, and its leaf; a line without a constant token has a leaf of its own."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    lines = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("at", "raw"))
    lines = lines.select("doc_id", "key", "at", masked(F.col("raw")).alias("masked")).where("masked != ''")
    n_tokens = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    head = F.when(fieldless(F.col("masked")), F.col("masked")).otherwise(F.substring_index(F.col("masked"), " ", DEPTH))
    return lines.select("doc_id", "key", "at", "masked", F.xxhash64("masked").alias("line"), n_tokens.alias("n_tokens"), F.xxhash64(head, n_tokens).alias("leaf"))


def shared_tokens(lines: DataFrame, whole: DataFrame) -> DataFrame:
    """Written (leaf, line, n_lines, n_tokens, p, token): the hashed tokens of the distinct lines that share a leaf.

    ``lines`` is the written part of ``whole``, which has the masked lines themselves and is read for those leaves only.
    """
    n_lines = lines.where(F.col("n_tokens") > DEPTH).select("leaf", "line").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"))
    shared = small(materialize(n_lines.where("n_lines >= 2"), "leaves"))
    distinct = whole.select("leaf", "line", "masked", "n_tokens").join(shared, "leaf").distinct()
    tokens = distinct.select("leaf", "line", "n_lines", "n_tokens", F.posexplode(F.split("masked", " ")).alias("p", "token"))
    return materialize(tokens.select("leaf", "line", "n_lines", "n_tokens", "p", F.xxhash64("token").alias("token")), "tokens")


def templates(tokens: DataFrame) -> DataFrame:
    """Written (line, template): the distinct lines that share a template with another.

    Lines that are not listed are templates alone.
    """
    constant = (
        tokens.groupBy("leaf", "p", "token")
        .agg(F.count(F.lit(1)).alias("times"), F.first("n_lines").alias("n_lines"))
        .where(2 * F.col("times") > F.col("n_lines"))
        .select("leaf", "p", "token")
    )
    agree = tokens.join(constant, ["leaf", "p", "token"]).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("same"), F.first("n_tokens").alias("n_tokens"))
    members = agree.where(F.col("same") >= SIMILARITY * F.col("n_tokens")).select("line", F.xxhash64(F.lit("leaf"), "leaf").alias("template"))
    return materialize(members, "templates")


def field_templates(tokens: DataFrame) -> DataFrame:
    """Written (line, template): the distinct lines that share all but one run of tokens with another.

    The runs overlap by half, so a field of up to half their length lies in one.
    """
    placed = tokens.where("n_tokens >= 5").select("leaf", "line", F.col("n_tokens").alias("n"), "p", F.xxhash64("token", "p").alias("h"))
    every = placed.groupBy("line").agg(F.bit_xor("h").alias("all"))
    run, q = F.floor(F.col("n") / 5), F.col("p") - DEPTH
    step = F.greatest(F.floor(run / 2), F.lit(1))
    number = F.sequence(F.greatest(F.ceil((q - run + 1) / step), F.lit(0)), F.floor(q / step))
    runs = placed.where(F.col("p") >= DEPTH).select("leaf", "line", "h", F.explode(number).alias("run"))
    runs = runs.groupBy("leaf", "line", "run").agg(F.bit_xor("h").alias("part")).join(every, "line")
    rests = runs.select("line", F.xxhash64(F.lit("field"), "leaf", "run", F.col("all").bitwiseXOR(F.col("part"))).alias("template"))
    rests = materialize(rests, "rests")
    several = rests.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("template")
    return materialize(rests.join(several, "template").select("line", "template"), "field_templates")


def recurring_fields(lines: DataFrame, tokens: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written (line, first_doc) like ``recurring``, with the templates of one variable field as well.

    A line can have several templates; the first of all their documents counts.
    """
    members = materialize(templates(tokens).unionByName(field_templates(tokens)), "members")
    alone = lines.select("key", "doc_id", F.col("line").alias("template"), "n_tokens")
    placed = alone.unionByName(lines.join(small(members), "line").select("key", "doc_id", "template", "n_tokens"))
    per_doc = placed.groupBy("template", "key").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
    often = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.first("n_tokens").alias("n_tokens"))
    often = materialize(often.where((F.col("n_docs") >= min_docs) | ((F.col("n_docs") >= 2) & (F.col("n_tokens") >= LONG_LINE))).select("template", "first_doc"), "recurring")
    found = often.withColumnRenamed("template", "line").unionByName(members.join(often, "template").select("line", "first_doc"))
    return materialize(found.groupBy("line").agg(F.min("first_doc").alias("first_doc")), "recurring_lines")


def recurring(lines: DataFrame, tokens: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written (line, first_doc): lines of templates that ``min_docs`` documents have, with the first of those."""
    members = small(templates(tokens))
    placed = lines.select("key", "doc_id", "line").join(members, "line", "left").select("key", "doc_id", "line", F.coalesce("template", "line").alias("template"))
    # a document counts once for a template: partial sums of its lines, then of documents
    per_doc = placed.groupBy("template", "key").agg(F.min("doc_id").alias("doc_id"))
    often = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)
    often = materialize(often.select("template", "first_doc"), "recurring")
    alone = often.withColumnRenamed("template", "line")
    grouped = members.join(often, "template").select("line", "first_doc")
    alone = alone.join(members, "line", "left_anti").select("line", "first_doc")
    return materialize(grouped.unionByName(alone), "recurring_lines")


def without_recurring(docs: DataFrame, min_docs: int, find: Callable[[DataFrame, DataFrame, int], DataFrame]) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` joined with what ``find`` finds; then the text that stays, its lines before, and the lines dropped."""
    # texts are split and masked twice: for the hashes of all lines, then for the words of lines that share a leaf
    whole = tree_lines(docs)
    lines = materialize(whole.drop("masked"), "tree_lines")
    often = small(find(lines, shared_tokens(lines, whole), min_docs))
    dropped = lines.select("key", "doc_id", "at", "line").join(often, "line").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    dropped = small(materialize(dropped.groupBy("key").agg(F.collect_set("at").alias("drop")), "dropped"))
    text = docs["text"].cast("string")
    joined = docs.join(dropped, F.xxhash64(docs["doc_id"].cast("long"), text) == dropped["key"], "left")
    every, drop = F.split(text, "\n", -1), dropped["drop"]
    kept = F.array_join(F.filter(every, lambda _, i: ~F.array_contains(drop, i)), "\n")
    count = lambda array: F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(0)).cast("long")
    return joined, F.when(drop.isNull(), text).otherwise(kept), count(every), count(drop)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, find: Callable[[DataFrame, DataFrame, int], DataFrame] = recurring_fields) -> DataFrame:
    """``docs`` with recurring lines, as ``find`` finds them, dropped from ``text``, and n_lines, n_dropped (long) as last columns.

    Columns of those two names make way; ``strip_lines`` keeps them.
    """
    joined, text, n_lines, n_dropped = without_recurring(docs, min_docs, find)
    others = [docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(*others, text.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def strip_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs``, all columns, without recurring lines and without the documents of which no line with a word stays.

    ``n_chars``, if there, follows a text that changed.  Null texts and texts that were blank stay.
    """
    joined, text, _, n_dropped = without_recurring(docs, min_docs, recurring_fields)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(n_dropped > 0, F.length(text).cast("long")).otherwise(docs["n_chars"])
    stays = (n_dropped == 0) | (trimmed(text) != "")
    return joined.where(stays).select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    return dedup_lines(docs.select("doc_id", "text"), find=recurring).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
