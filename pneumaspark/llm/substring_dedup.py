"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference.  Windows of 20 words are the letters that factors
are made of: a factor of ``n`` windows copies ``n + 19`` words from an earlier place,
so every factor is long enough to count.  A document is factored greedily; at each
window that no factor covers yet, the earlier place with the longest run of equal
windows is sought.  Windows across the boundary of two factors of words belong to
neither and are looked up for themselves, so no copied window is missed.

1. A task factors a block of documents against the block itself and sends the
   block's first windows to the reference blocks of all documents.
2. A window's reference block is set by its anchor, the least hash among its 8-word
   runs.  Equal windows have equal anchors, so a document can only copy from the
   blocks of its own anchors and is parsed against these alone.  Neighbouring
   windows mostly share their anchor: an index row holds a run of them, six bytes each.
   An anchor whose bucket has many rows, by counts over all documents, is split: its
   windows are then dealt one by one, by their own hash.
3. In a reference block the pieces of the documents are factored in document order.
   Only pieces that hold a window for the first time stay as reference.
4. A document's factors are joined where both it and the source go on; the covered
   words are removed.

"Longest" is up to a factor of two: the source is the earliest of those that share
2**k windows, with the largest k that has one, and is followed to its end.

Windows compare by 48 hash bits below a 64-bit anchor.  Null and empty texts have
no words.  Documents are ordered by ``doc_id``; texts that share a doc_id are
documents of their own, ordered by a hash of the text.  Rows that repeat a doc_id and
its text count as one document and get equal rows.  Rows whose doc_id is null are
compared with nothing and keep all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import WordHash, arrow_schema, id_text, mix64, record_batch

WINDOW = 20
RUN = 8
TAG = 6
#: Text of a block; its windows take about 20 times as much in arrays.
BLOCK_BYTES = 6 << 20
#: Windows of a reference block that are parsed at once.
CHUNK_WINDOWS = 500_000
#: Anchors are counted in buckets; one with more rows than HOT_ROWS and HOT_SHARE times the mean is split.
BUCKETS, HOT_ROWS, HOT_SHARE = 1 << 16, 4096, 4
#: Factors are at most so many doublings long before they are joined.
LEVELS = 7

INDEX_DDL = "anchor long, doc_id long, tid int, start int, tags binary"
FACTOR_DDL = "doc_id long, tid int, start int, n int, src_doc long, src_start int"
#: A factor that a block found within itself travels in ``tags`` in this form, whose size no run of windows has.
LOCAL = np.dtype([("n", "<i4"), ("src_start", "<i4"), ("src_doc", "<i8")])


def least_in_window(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, g
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def first_in_group(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``places`` (ascending), the first with an equal key, and whether it has company."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    head = np.flatnonzero(new)
    sizes = np.diff(np.append(head, len(keys)))
    first, several = np.empty(len(keys), np.int32), np.empty(len(keys), bool)
    first[order] = places[order[np.repeat(head, sizes)]]
    several[order] = np.repeat(sizes > 1, sizes)
    return first, several


def equal_runs(keys: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """By level k: the first place whose 2**k keys equal those at a place, which is itself if there is none before.

    ``room`` counts the keys from a place to the end of its piece; runs end there.
    """
    every = np.arange(len(keys), dtype=np.int32)
    first, several = first_in_group(keys, every)
    levels, step = [first], 1
    for _ in range(LEVELS):
        some = np.flatnonzero(several & (room >= 2 * step)).astype(np.int32)
        some = some[several[some + step]]
        if not len(some):
            break
        pair = (first[some].astype(np.uint64) << np.uint64(32)) | first[some + step].astype(np.uint64)
        found, company = first_in_group(pair, some)
        first, several = every.copy(), np.zeros(len(keys), bool)
        first[some], several[some] = found, company
        if not company.any():
            break
        levels.append(first)
        step *= 2
    return levels


def parse(keys: np.ndarray, piece: np.ndarray, same_place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (at, length, source) of pieces of keys, and which places have an earlier copy.

    ``piece`` numbers the pieces; all their cursors advance together.  ``same_place``
    numbers the places of the corpus, where rows repeat: a place is no copy of itself.
    """
    n = len(keys)
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    ends = np.append(starts[1:], n)
    room = np.repeat(ends, ends - starts) - np.arange(n)
    levels = equal_runs(keys, room)
    own = np.arange(n) if same_place is None else same_place
    copied = own[levels[0]] != own
    upcoming = np.minimum.accumulate(np.where(copied, np.arange(n), n)[::-1])[::-1]
    upcoming = np.append(upcoming, n)
    at, length, source = [], [], []
    cursor, stop = upcoming[starts], ends
    while True:
        going = cursor < stop
        if not going.any():
            break
        cursor, stop = cursor[going], stop[going]
        src, size = levels[0][cursor], np.ones(len(cursor), np.int64)
        for k in range(1, len(levels)):
            better = own[levels[k][cursor]] != own[cursor]
            src = np.where(better, levels[k][cursor], src)
            size = np.where(better, 1 << k, size)
        left = np.minimum(room[cursor], room[src])
        for k in range(len(levels) - 1, -1, -1):
            fits = left - size >= 1 << k
            a, b = np.minimum(cursor + size, n - 1), np.minimum(src + size, n - 1)
            size += np.where(fits & (levels[k][a] == levels[k][b]), 1 << k, 0)
        at.append(cursor)
        length.append(size)
        source.append(src)
        cursor = upcoming[cursor + size]
    if not at:
        none = np.empty(0, np.int64)
        return none, none, none, copied
    return np.concatenate(at), np.concatenate(length), np.concatenate(source), copied


def block_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's texts in one row, and the words of each text."""
    word_hash = WordHash.of()
    parts = [word_hash((t or b"").split()) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def block_windows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, window hash, anchor) of each window of a block."""
    words, sizes = block_words(texts)
    n_windows = np.maximum(sizes - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n_windows)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)).astype(np.int32)
    if not len(doc):
        return doc, start, np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = start + np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), n_windows)
    n = len(words) - RUN + 1
    g = np.zeros(n, np.uint64)
    for j in range(RUN):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += words[j : j + n]
    g = mix64(g)
    window = mix64((g[at] * np.uint64(0xC2B2AE3D27D4EB4F) + g[at + RUN]) * np.uint64(0x9E3779B97F4A7C15) + g[at + WINDOW - RUN])
    return doc, start, window, least_in_window(g, WINDOW - RUN + 1)[at]


def piece_starts(doc: np.ndarray, start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether a window begins a piece: its anchor, its document or its place doesn't follow the window before."""
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(start) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    return new


def binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of consecutive pieces of ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def block_index(ids: list, tids: list, texts: list, hot: np.ndarray, schema: pa.Schema) -> list[pa.RecordBatch]:
    """Index rows of a block's first windows, and the factors that it has within itself."""
    rows = sorted({(i, k): t for i, k, t in zip(ids, tids, texts, strict=True) if i is not None and t}.items())
    if not rows:
        return []
    doc, start, window, anchor = block_windows([t for _, t in rows])
    if not len(doc):
        return []
    doc_id, tid = np.array([i for (i, _), _ in rows], np.int64), np.array([k for (_, k), _ in rows], np.int32)
    at, length, source, copied = parse(window, doc)
    local = np.empty(len(at), LOCAL)
    local["n"], local["src_start"], local["src_doc"] = length, start[source], doc_id[doc[source]]
    spread = mix64(doc_id[doc[at]].view(np.uint64) + start[at].astype(np.uint64)).view(np.int64)
    found = [pa.RecordBatch.from_arrays([pa.array(spread), pa.array(doc_id[doc[at]]), pa.array(tid[doc[at]]), pa.array(start[at]), binary(local.tobytes(), np.full(len(at), LOCAL.itemsize))], schema=schema)]

    mine = np.flatnonzero(~copied)
    doc, start, window, anchor = doc[mine], start[mine], window[mine], anchor[mine]
    new = piece_starts(doc, start, anchor)
    if len(hot):
        bucket = (anchor >> np.uint64(48)).astype(np.int32)
        split = hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket
        # a window of a split anchor has an anchor of its own, in a bucket where it stays
        anchor = np.where(split, mix64(anchor ^ window), anchor)
        new |= split
        new[1:] |= split[:-1]
    lead = np.flatnonzero(new)
    sizes = np.diff(np.append(lead, len(mine)))
    tags = np.ascontiguousarray(window.view(np.uint8).reshape(-1, 8)[:, :TAG]).tobytes()
    found.append(pa.RecordBatch.from_arrays([pa.array(anchor[lead].view(np.int64)), pa.array(doc_id[doc[lead]]), pa.array(tid[doc[lead]]), pa.array(start[lead]), binary(tags, sizes * TAG)], schema=schema))
    return found


def reference_factors(rows: pa.Table, n_known: int, schema: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """Factors of the index rows of whole anchors, and which rows hold a window for the first time.

    Rows are in the order of anchors and documents.  The first ``n_known`` are reference
    only: their factors are known.
    """
    anchor, doc_id, tid, first = (rows.column(k).to_numpy() for k in range(4))
    column = rows.column(4).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    sizes, data = np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", np.uint8)
    is_local = sizes == LOCAL.itemsize
    parts = []
    mine = np.flatnonzero(is_local & (np.arange(len(sizes)) >= n_known))
    if len(mine):
        local = np.ascontiguousarray(data[offsets[mine][:, None] + np.arange(LOCAL.itemsize)]).view(LOCAL).ravel()
        parts.append((doc_id[mine], tid[mine], first[mine], local["n"], local["src_doc"], local["src_start"]))
    count = np.where(is_local, 0, sizes // TAG)
    total = int(count.sum())
    news = np.zeros(len(sizes), bool)
    if total:
        row = np.repeat(np.arange(len(sizes)), count)
        number = (np.arange(total) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        packed = np.zeros((total, 8), np.uint8)
        packed[:, :TAG] = data[(offsets[row] + TAG * number)[:, None] + np.arange(TAG)]
        keys = mix64(packed.view(np.uint64).ravel() ^ mix64(anchor.view(np.uint64))[row])
        del packed
        start = first[row] + number
        # rows that repeat a document repeat its places
        place = mix64(mix64(mix64(doc_id.view(np.uint64)) + tid.astype(np.uint64))[row] + start.astype(np.uint64))
        at, length, source, copied = parse(keys, row, first_in_group(place, np.arange(total, dtype=np.int32))[0])
        news[row[~copied]] = True
        fresh = row[at] >= n_known
        at, length, source = at[fresh], length[fresh], source[fresh]
        parts.append((doc_id[row[at]], tid[row[at]], start[at], length, doc_id[row[source]], start[source]))
    cols = {f.name: np.concatenate([p[k] for p in parts]) if parts else [] for k, f in enumerate(schema)}
    return record_batch(cols, schema), news


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """Sorted buckets of anchors that are split, by the pieces that all documents have; at most ``BUCKETS / HOT_SHARE``."""
    schema = arrow_schema("bucket int, n long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for ids, _, texts in text_blocks(batches):
            doc, start, _, anchor = block_windows(texts)
            if len(doc):
                total += np.bincount((anchor[piece_starts(doc, start, anchor)] >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield record_batch({"bucket": seen, "n": total[seen]}, schema)

    found = with_tid(docs).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = found["n"].to_numpy()
    return np.sort(found["bucket"].to_numpy()[n > max(HOT_ROWS, HOT_SHARE * n.sum() / BUCKETS)]).astype(np.int32)


def with_tid(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells the texts of one doc_id apart."""
    return id_text(docs).select("doc_id", F.hash("text").alias("tid"), "text")


def text_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, tids, texts) of consecutive rows, about ``BLOCK_BYTES`` of text each."""
    ids, tids, texts, held = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            tids.append(k)
            texts.append(t)
            held += len(t or b"")
            if held >= BLOCK_BYTES:
                yield ids, tids, texts
                ids, tids, texts, held = [], [], [], 0
    if ids:
        yield ids, tids, texts


def duplicate_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, start, n, src_doc, src_start): ``n`` windows from word ``start`` on that stand earlier, and where."""
    index_schema, factor_schema = arrow_schema(INDEX_DDL), arrow_schema(FACTOR_DDL)
    hot = docs.sparkSession.sparkContext.broadcast(hot_buckets(docs))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tids, texts in text_blocks(batches):
            for found in block_index(ids, tids, texts, hot.value, index_schema):
                for at in range(0, found.num_rows, 50_000):
                    yield found.slice(at, 50_000)

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_known = windows = 0
        for batch in batches:
            held.append(batch)
            windows += batch.column(4).nbytes // TAG
            if windows < CHUNK_WINDOWS:
                continue
            rows = pa.Table.from_batches(held)
            found, news = reference_factors(rows, n_known, factor_schema)
            yield found
            # the last anchor may go on: what it has for the first time stays as reference
            anchor = rows.column(0).to_numpy()
            stays = news & (anchor == anchor[-1])
            rest = rows.filter(pa.array(stays)).combine_chunks()
            held, n_known, windows = rest.to_batches(), rest.num_rows, 0
        if held:
            yield reference_factors(pa.Table.from_batches(held), n_known, factor_schema)[0]

    dealt = with_tid(docs).mapInArrow(index, INDEX_DDL).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tid", "start")
    return dealt.mapInArrow(resolve, FACTOR_DDL)


def joined_factors(factors: list) -> list[dict]:
    """A document's factors in order, joined where both ends go on; lengths in words."""
    out: list[dict] = []
    windows = 0
    for f in sorted(factors, key=lambda f: (f["start"], -f["n"])):
        if out:
            last, done = out[-1], out[-1]["start"] + windows
            if f["start"] + f["n"] <= done:
                continue
            if f["start"] <= done and f["src_doc"] == last["src_doc"] and f["src_start"] - f["start"] == last["src_start"] - last["start"]:
                windows = f["start"] + f["n"] - last["start"]
                last["n_words"] = windows + WINDOW - 1
                continue
        windows = f["n"]
        out.append({"start": f["start"], "n_words": windows + WINDOW - 1, "src_doc": f["src_doc"], "src_start": f["src_start"]})
    return out


FACTOR = "array<struct<start:int,n_words:int,src_doc:long,src_start:int>>"


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, n_factors, kept, factors.

    ``kept`` holds the words that stay, joined by one space; ``factors`` the copied spans
    (start, n_words) with their sources; ``n_factors`` counts the runs of removed words.
    """
    found = duplicate_factors(docs).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_start")).alias("found"))
    rows = with_tid(docs)
    joined = rows.join(found, ["doc_id", "tid"], "left").select("doc_id", "text", "found")
    ddl = f"doc_id long, n_words long, n_removed long, n_factors long, kept string, factors {FACTOR}"
    schema = arrow_schema(ddl)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            cols: dict[str, list] = {f.name: [] for f in schema}
            cols["doc_id"] = batch.column(0)
            for text, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                removed = runs = 0
                factors = joined_factors(found) if found else []
                if factors:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [f["start"] for f in factors], 1)
                    np.add.at(edge, [f["start"] + f["n_words"] for f in factors], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
                    words = [words[k] for k in np.flatnonzero(~gone)]
                cols["n_words"].append(len(words) + removed)
                cols["n_removed"].append(removed)
                cols["n_factors"].append(runs)
                cols["kept"].append(b" ".join(words).decode("utf-8", "replace"))
                cols["factors"].append(factors)
            yield record_batch(cols, schema)

    return joined.mapInArrow(cut, ddl)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256; and n_factors."""
    return remove_duplicates(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_factors")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The contract on a few documents, word by word; for tests."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i : i + WINDOW])
            if window in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
