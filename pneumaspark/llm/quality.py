"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over blocks of documents,
mark the words that lie in an n-gram found twice or more in their document; the
characters of marked words, as a share of all, are held against a limit for each
length.  Lines equal to an earlier line of the document count the same way, and a
text may not carry more symbols than a share of its words.

A document is kept if the base rules pass (words enough, not mostly repeated
3-word windows) and no coverage exceeds its limit.  Null and empty texts have no
words and are rejected by the base rules.  Repeated rows get equal rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import map_docs, mix64

#: Highest share of characters in repeated n-grams by n, and in repeated lines.
NGRAM_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
#: Most symbols for each word.
SYMBOL_LIMIT = 0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Texts are measured together up to about so many bytes.
BLOCK_BYTES = 4 << 20

DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)


def repeated_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, bytes other than spaces in them)."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[bytes] = set()
    count = held = 0
    for line in lines:
        if line in seen:
            words = line.split()
            count += bool(words)
            held += sum(map(len, words))
        seen.add(line)
    return count, held


def covered(hashes: np.ndarray, starts: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(words covered by n-grams that occur twice, starts of those n-grams)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = starts[order[twice]]
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0, np.sort(at)


def measure(texts: list[bytes | None]) -> dict:
    """All measures of a block of documents, by column."""
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids, lengths, counts, lines, line_bytes, symbols = [], [], [], [], [], []
    for t in texts:
        t = t or b""
        split = t.split()
        counts.append(len(split))
        ids += map(known.__getitem__, split)
        lengths += map(len, split)
        n, held = repeated_lines(t)
        lines.append(n)
        line_bytes.append(held)
        symbols.append(sum(t.count(c) for c in SYMBOLS.encode()))
    counts_a = np.array(counts, np.int64)
    n_words = int(counts_a.sum())
    doc = np.repeat(np.arange(len(texts)), counts_a)
    word = mix64(np.array(ids, np.uint64) + np.uint64(1))
    size = np.array(lengths, np.int64)
    total = np.bincount(doc, size, len(texts))
    ends = np.repeat(np.cumsum(counts_a), counts_a)

    # 3-grams first; a longer n-gram can repeat only where its first three words do
    shares = np.zeros((len(NGRAM_LIMITS), len(texts)))
    repeat = np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(np.arange(n_words) + 3 <= ends)
    if len(starts):
        salt = mix64(doc.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        step = np.uint64(0x9E3779B97F4A7C15)
        rolled = ((word[starts] * step + word[starts + 1]) * step) + word[starts + 2]
        mask, starts = covered(mix64(rolled ^ salt[starts]), starts, 3, n_words)
        repeat = np.bincount(doc[mask], minlength=len(texts))
        for row, n in enumerate(NGRAM_LIMITS):
            starts = starts[starts + n <= ends[starts]]
            if not len(starts):
                break
            rolled = np.zeros(len(starts), np.uint64)
            for j in range(n):
                rolled = rolled * step + word[starts + j]
            mask, starts = covered(mix64(rolled ^ salt[starts]), starts, n, n_words)
            shares[row] = np.bincount(doc[mask], size[mask], len(texts)) / np.maximum(total, 1)
    line_share = np.array(line_bytes) / np.maximum(total, 1)
    base_failed = (counts_a < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts_a)
    over = (shares > np.array(list(NGRAM_LIMITS.values()))[:, None]).any(axis=0) | (line_share > LINE_LIMIT) | (np.array(symbols) > SYMBOL_LIMIT * counts_a)
    chars = [len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in SPACES.encode()) if t else 0 for t in texts]
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & ~over,
        "dup_line_share": line_share,
        "dup_ngram_share": shares[0],
    }


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with the measures, ``base_failed`` and ``kept``."""
    return map_docs(docs, lambda ids, texts: {"doc_id": ids, **measure(texts)}, DDL)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep: one pass over the rows, each judged by its own text."""
    at = docs.columns.index("text")
    own = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            ends = np.cumsum([len(t) + 64 for t in texts.fill_null(b"").to_pylist()]) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield batch.slice(a, b - a).filter(pa.array(measure(texts.slice(a, b - a).to_pylist())["kept"], pa.bool_()))

    return own.mapInArrow(run, own.schema)
