"""Sequence packing by non-negative least squares over a length histogram.

Each task packs the documents it reads, in blocks of bounded size, so nothing is
shuffled and no group is ever collected.  In a block:

1. a document's whole windows of 4096 ids become sequences of their own;
2. what remains of each document is binned by length, in units of 64 ids;
3. combinations of at most three bins that fill a window exactly are the
   strategies; non-negative least squares finds how often to use each so that
   the use of bins comes closest to the histogram; the counts are rounded down
   and limited to the pieces there are;
4. pieces left over are packed greedily, the longest that fits first; a piece is
   cut where a gap of at least ``MIN_CUT`` ids would stay open.

The open last sequence goes on to the task's next block.  The last of the task is
cut at the powers of two of its length, which need no padding.

Null text is the empty document, which has the end id alone.  Repeated rows are
packed each time.  An empty table gives no rows.  Sequence ids hold the task's
partition number, so the input must be split alike when a task runs again: read
it from files, as the query and the pipeline do.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pneumaspark.llm.common import WordEncoder, arrow_schema, id_text, record_batch, rows_of

WINDOW = 4096
UNIT = 64
DEPTH = 3
END_ID = 2
MIN_CUT = 32
BLOCK_IDS = 6_000_000

DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def strategies(n_bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every multiset of at most ``depth`` bins 1..n_bins whose sum is n_bins."""

    def parts(total: int, least: int, left: int) -> Iterator[tuple[int, ...]]:
        if left >= 1 and total >= least:
            yield (total,)
        if left >= 2:
            for first in range(least, total // 2 + 1):
                for rest in parts(total - first, first, left - 1):
                    yield (first, *rest)

    return list(parts(n_bins, 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min ||a x - b|| with x >= 0, by Lawson and Hanson's active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = target - gram @ x
        gain[free] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tol:
            break
        free[j] = True
        while True:
            on = np.flatnonzero(free)
            s = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            drop = on[low & (x[on] <= 1e-12)]
            drop = drop if len(drop) else on[low][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


class Packer:
    """Packs pieces ``(length, number, start, document)``; a document is (doc_id, ids, n)."""

    def __init__(self, window: int = WINDOW, unit: int = UNIT):
        self.window, self.unit = window, unit
        self.combos = strategies(window // unit)
        self.matrix = np.zeros((window // unit, len(self.combos)))
        for j, combo in enumerate(self.combos):
            for b in combo:
                self.matrix[b - 1, j] += 1

    def pack(self, pieces: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
        """Sequences, and the pieces of the last one if it stays open."""
        n_bins = self.window // self.unit
        bins: list[list[tuple]] = [[] for _ in range(n_bins + 1)]
        for p in sorted(pieces, key=lambda p: p[:3]):
            bins[-(-p[0] // self.unit)].append(p)
        counts = nnls(self.matrix, np.array([len(b) for b in bins[1:]], float))
        sequences: list[list[tuple]] = []
        for j in np.argsort(-counts, kind="stable"):
            combo = self.combos[j]
            times = min([int(counts[j] + 1e-6), *(len(bins[b]) // combo.count(b) for b in combo)])
            sequences += [[bins[b].pop() for b in combo] for _ in range(times)]
        left = sorted((p for b in bins for p in b), key=lambda p: p[:3])
        for s in sequences:
            self.fill(s, left)
        last: list[tuple] = []
        while left:
            last = [left.pop()]
            self.fill(last, left)
            if left or sum(p[0] for p in last) > self.window - MIN_CUT:
                sequences.append(last)
                last = []
        return sequences, last

    def fill(self, sequence: list[tuple], left: list[tuple]) -> None:
        """Take the longest pieces that fit; cut one where they leave a gap."""
        gap = self.window - sum(p[0] for p in sequence)
        while gap and left:
            k = bisect_right(left, gap, key=lambda p: p[0])
            if k:
                sequence.append(left.pop(k - 1))
                gap -= sequence[-1][0]
            elif gap >= MIN_CUT and left[-1][0] - gap >= MIN_CUT:
                length, number, start, doc = left.pop()
                sequence.append((gap, number, start, doc))
                insort(left, (length - gap, number, start + gap, doc), key=lambda p: p[:3])
                gap = 0
            else:
                return


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """Cut a run of pieces into sequences whose lengths are powers of two."""
    total, out = sum(p[0] for p in pieces), []
    todo = list(reversed(pieces))
    for k in reversed(range(total.bit_length())):
        if total >> k & 1:
            need, sequence = 1 << k, []
            while need:
                length, number, start, doc = todo.pop()
                take = min(length, need)
                sequence.append((take, number, start, doc))
                need -= take
                if take < length:
                    todo.append((length - take, number, start + take, doc))
            out.append(sequence)
    return out


def pack_stream(documents: Iterable[tuple], first_id: int, block_ids: int = BLOCK_IDS) -> Iterator[list[tuple]]:
    """Rows for (doc_id, ids) pairs, a block at a time; ids are little-endian 32-bit bytes."""
    packer, next_id = Packer(), first_id
    pieces: list[tuple] = []
    whole: list[list[tuple]] = []
    held = number = 0

    def rows(sequences: list[list[tuple]]) -> list[tuple]:
        nonlocal next_id
        out = []
        for sequence in sequences:
            offset = 0
            for length, _, start, (doc_id, ids, n) in sequence:
                out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, next_id, offset))
                offset += length
            next_id += 1
        return out

    for doc_id, ids in documents:
        n = len(ids) // 4
        doc, cut = (doc_id, ids, n), n - n % WINDOW
        whole += [[(WINDOW, number, at, doc)] for at in range(0, cut, WINDOW)]
        if cut < n:
            pieces.append((n - cut, number, cut, doc))
        number += 1
        held += n
        if held >= block_ids:
            sequences, pieces = packer.pack(pieces)
            yield rows(whole + sequences)
            whole, held = [], sum(p[0] for p in pieces)
    if whole or pieces:
        sequences, last = packer.pack(pieces)
        yield rows(whole + sequences + powers(last))


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    schema = arrow_schema(DDL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer).encode
        end = np.array([END_ID], "<u4").tobytes()
        documents = ((doc_id, encode(text) + end) for batch in batches for doc_id, text in rows_of(batch))
        for rows in pack_stream(documents, TaskContext.get().partitionId() << 32):
            yield record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return id_text(docs).mapInArrow(run, DDL)
