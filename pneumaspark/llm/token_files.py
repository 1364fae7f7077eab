"""Files of token ids in Simple-8b words, written and read through a Spark data source.

The code.  An id sequence is cut into blocks of ``BLOCK`` ids.  A block is a run
of 64-bit words: four bits of selector, sixty of payload.

=========  ==================================================================
selector   payload
=========  ==================================================================
0          escape: that many ids follow whole, in the block's list of escapes
1          run: 28 bits of count, 32 bits of an id that is repeated
2 to 15    as many ids as fit in a width of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15,
           20, 30 or 60 bits, lowest bits first
=========  ==================================================================

Escapes hold ids of 2**60 and more.  A word takes as many ids as any selector allows;
the last word of a block may be padded, for a block's number of ids is known.
Words are found for all positions of a block at once from running counts of ids
too wide for a selector, then followed from word to word; decoding takes all words
of one selector together.

The file.  Head: magic, format version, block size.  Then the blocks' words and
escapes; the table of blocks (byte offset, words, escapes); the table of documents
(doc_id, number of ids, flags), and a tail of fixed size that says where they are.  Any
range of ids is read by its blocks alone.

The data source ``token_ids``.  Documents are dealt by ranges of (doc_id, hash of
the text, row), so a doc_id or text that many rows share is spread too; each task
encodes and writes one file under a name of its own attempt, and the driver commits
a manifest with the files in order, their ids and their documents: files of
failed attempts aren't in it and are never read.  The reader plans tasks of about
``TASK_IDS`` ids from the manifest alone.  Paths are opened with ``pyarrow.fs``, so
local, HDFS, S3 and GCS paths will do where the workers have their drivers.

Null text is the empty document, which has the end id alone; a null doc_id is kept
and comes first.  Rows of one doc_id are ordered by their texts' hashes, equal rows as they come; an empty table
gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pneumaspark.llm.common import _BYTE_NAMES, arrow_schema, blocks, record_batch
from pneumaspark.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 65_536
TASK_IDS = 4_000_000
ROWS = "doc_id long, start long, ids binary"
#: The same for Arrow: the source plans and reads in processes without a session.
ARROW_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

# ---- the code

ESCAPE, RUN = 0, 1
#: Widths of selectors 2 to 15 and how many ids a word then has.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNTS = 60 // WIDTHS
#: A run has to be longer than the ids that its word could take otherwise.
LEAST_RUN = 61
_U = np.uint64


def _classes(ids: np.ndarray) -> np.ndarray:
    """How many widths are too narrow for each id; 14 for ids that only an escape can hold."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_U(1) << WIDTHS.astype(np.uint64), ids, side="right").astype(np.int8)


_SMALL = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), side="right").astype(np.int8)


def _choices(classes: np.ndarray) -> np.ndarray:
    """The selector that takes most ids at each position, by the widest of the ids that each would take."""
    n = len(classes)
    padded = np.concatenate((classes, np.zeros(60, np.int8)))  # beyond the end anything fits
    widest = {1: padded}
    for c in COUNTS[::-1].tolist()[1:]:
        half = max(x for x in widest if x < c and 2 * x >= c)  # two windows that overlap make one
        held = widest[half]
        longer = held.copy()
        np.maximum(held[: len(held) - (c - half)], held[c - half :], out=longer[: len(held) - (c - half)])
        widest[c] = longer
    choice = np.full(n, ESCAPE, np.int8)
    for k in range(len(WIDTHS) - 1, -1, -1):
        np.copyto(choice, k + 2, where=widest[int(COUNTS[k])][:n] <= k)
    return choice


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of one block of unsigned ids."""
    n = len(ids)
    classes = _classes(ids)
    choice = _choices(classes)
    took = np.concatenate(([1, 1], COUNTS))[choice]
    at = np.arange(n)

    def left(apart: np.ndarray) -> np.ndarray:
        """Positions from each one to the end of its run; ``apart``: whether a run ends before the next position."""
        ends = np.concatenate((np.flatnonzero(apart), [n - 1]))
        return np.repeat(ends, np.diff(ends, prepend=-1)) - at + 1

    apart = ids[1:] != ids[:-1]
    if n >= LEAST_RUN and np.diff(np.flatnonzero(apart), prepend=-1, append=n - 1).max() >= LEAST_RUN:
        rest = left(apart)
        run = (rest >= LEAST_RUN) & (ids < _U(1 << 32))
        choice[run], took[run] = RUN, rest[run]
    escaped = choice == ESCAPE
    if escaped.any():
        took[escaped] = left(escaped[1:] != escaped[:-1])[escaped]
    starts, k, steps = [], 0, took.astype(np.uint8).tobytes() if took.max(initial=0) < 256 else took.tolist()
    while k < n:
        starts.append(k)
        k += steps[k]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << _U(60)
    padded = np.concatenate((ids.astype(np.uint64), np.zeros(60, np.uint64)))
    for s in np.unique(chosen).tolist():
        on = np.flatnonzero(chosen == s)
        first = starts[on]
        if s == ESCAPE:
            words[on] |= took[first].astype(np.uint64)
        elif s == RUN:
            words[on] |= took[first].astype(np.uint64) << _U(32) | padded[first]
        else:
            w, c = int(WIDTHS[s - 2]), int(COUNTS[s - 2])
            taken = padded[first]
            for j in range(1, c):
                taken |= padded[first + j] << _U(w * j)
            words[on] |= taken
    return words, padded[:n][escaped]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, as unsigned 64-bit integers."""
    chosen = (words >> _U(60)).astype(np.int64)
    payload = words & _U((1 << 60) - 1)
    counts = np.where(chosen == ESCAPE, payload.astype(np.int64), np.where(chosen == RUN, (payload >> _U(32)).astype(np.int64), COUNTS[np.maximum(chosen - 2, 0)]))
    start = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    escaped = 0
    for s in np.unique(chosen):
        on = np.flatnonzero(chosen == s)
        if s >= 2:
            w, c = int(WIDTHS[s - 2]), int(COUNTS[s - 2])
            first, taken, mask = start[on], payload[on], _U((1 << w) - 1)
            for j in range(c):
                out[first + j] = taken >> _U(w * j) & mask
            continue
        for k in on.tolist():  # runs and escapes: each stands for many ids
            at, m = int(start[k]), int(counts[k])
            if s == RUN:
                out[at : at + m] = payload[k] & _U(0xFFFFFFFF)
            else:
                out[at : at + m] = escapes[escaped : escaped + m]
                escaped += m
    return out[:n]


# ---- the file

MAGIC = b"TIDS8B\r\n"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCKS = np.dtype([("at", "<u8"), ("words", "<u4"), ("escapes", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("n", "<u8"), ("known", "<u1")])


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FileWriter:
    """Appends documents' ids to a file, a block at a time; memory is one block and the documents' table."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.at = out, block, HEAD.size
        self.open: list[np.ndarray] = []
        self.held = self.n_ids = self.n_docs = 0
        self.blocks: list[tuple] = []
        self.docs: list[np.ndarray] = []
        out.write(HEAD.pack(MAGIC, 1, block))

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        table = np.zeros(len(ids), DOCS)
        table["doc_id"], table["known"], table["n"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids], [len(x) for x in ids]
        self.docs.append(table)
        self.n_docs += len(ids)
        for x in ids:
            self.n_ids += len(x)
            self.open.append(x)
            self.held += len(x)
            if self.held >= 8 * self.block:
                self._flush(self.held // self.block)

    def _flush(self, n_blocks: int) -> None:
        whole = np.concatenate(self.open) if self.open else np.empty(0, np.uint64)
        cut = min(n_blocks * self.block, len(whole))
        for a in range(0, cut, self.block):
            words, escapes = encode_block(whole[a : min(a + self.block, cut)])
            self.out.write(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(escapes)))
            self.at += 8 * (len(words) + len(escapes))
        self.open, self.held = [whole[cut:]], len(whole) - cut

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.block))
        blocks, docs = np.array(self.blocks, BLOCKS), np.concatenate([np.empty(0, DOCS), *self.docs])
        self.out.write(blocks.tobytes() + docs.tobytes())
        self.out.write(TAIL.pack(self.at, len(blocks), len(docs), self.n_ids, MAGIC))


class FileReader:
    """A file's tables, and any range of its ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.at, n_blocks, n_docs, self.n_ids, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        head, version, self.block = HEAD.unpack(source.read_at(HEAD.size, 0))
        if magic != MAGIC or head != MAGIC or version != 1:
            raise ValueError("not a file of token ids, or one cut short")
        tables = source.read_at(n_blocks * BLOCKS.itemsize + n_docs * DOCS.itemsize, self.at)
        self.blocks = np.frombuffer(tables, BLOCKS, n_blocks)
        self.docs = np.frombuffer(tables, DOCS, n_docs, n_blocks * BLOCKS.itemsize)
        n = self.docs["n"].astype(np.int64)
        self.starts = np.cumsum(n) - n

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last``, the latter exclusive; only their blocks are read, in one piece."""
        if first >= last:
            return np.empty(0, np.uint64)
        a, b = first // self.block, -(-last // self.block)
        t = self.blocks[a:b]
        base, end = int(t["at"][0]), int(t["at"][-1]) + 8 * (int(t["words"][-1]) + int(t["escapes"][-1]))
        data = np.frombuffer(self.source.read_at(end - base, base), "<u8")
        out = []
        for k, (at, words, escapes) in enumerate(t.tolist(), a):
            w = (at - base) // 8
            out.append(decode_block(data[w : w + words], data[w + words : w + words + escapes], min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(out)[first - a * self.block : last - a * self.block]


# ---- the data source


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    n_ids: int
    n_docs: int


class TokenWriter(DataSourceArrowWriter):
    """Writes rows of (doc_id, ids as little-endian unsigned 32-bit bytes), a file for each task with rows."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path.rstrip("/"), block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        part, writer, out = TaskContext.get().partitionId(), None, None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    out = system.open_output_stream(f"{folder}/{name}")
                    writer = FileWriter(out, self.block)
                writer.add(batch.column(0).to_pylist(), [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()])
        if writer is None:
            return Written(part, "", 0, 0)
        writer.close()
        out.close()
        return Written(part, name, writer.n_ids, writer.n_docs)

    def commit(self, messages: list[Written | None]) -> None:
        start, files = 0, []
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "start": start, "n_ids": m.n_ids, "n_docs": m.n_docs})
            start += m.n_ids
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"n_ids": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{folder}/{m.name}")


class TokenReader(DataSourceReader):
    """Reads documents back: doc_id, the number of ids before it, and its ids."""

    def __init__(self, path: str, task_ids: int):
        self.path, self.task_ids = path.rstrip("/"), task_ids

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.path)
        with system.open_input_stream(f"{folder}/manifest.json") as source:
            files = json.loads(source.read())["files"]
        cuts = [(f["name"], f["start"], a, min(a + self.task_ids, f["n_ids"])) for f in files for a in range(0, f["n_ids"], self.task_ids)]
        return [InputPartition(c) for c in cuts] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Documents whose first id lies in the partition's range of ids."""
        if partition.value is None:
            return
        name, before, low, high = partition.value
        system, folder = opened(self.path)
        with system.open_input_file(f"{folder}/{name}") as source:
            file = FileReader(source)
            a, b = np.searchsorted(file.starts, [low, high])
            while a < b:  # a megabyte of ids or so at a time
                z = min(b, max(a + 1, int(np.searchsorted(file.starts, file.starts[a] + 4 * BLOCK))))
                docs, starts = file.docs[a:z], file.starts[a:z]
                ends = starts + docs["n"].astype(np.int64)
                ids = file.ids(int(starts[0]), int(ends[-1])).astype("<u4")
                rows = [ids[s - starts[0] : e - starts[0]].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                known = docs["known"].tolist()
                yield record_batch({"doc_id": [d if k else None for d, k in zip(docs["doc_id"].tolist(), known, strict=True)], "start": starts + before, "ids": rows}, ARROW_ROWS)
                a = z


class TokenIds(DataSource):
    """``spark.read.format("token_ids").load(path)`` and ``df.write.format("token_ids").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], int(self.options.get("task_ids", TASK_IDS)))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options.get("block", BLOCK)))


# ---- documents to files and back


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids): every document's ids and its end, in order of doc_id across and within partitions."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = [F.asc_nulls_first("doc_id"), F.asc("_hash"), F.asc("_row")]
    ordered = own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ddl = "doc_id long, ids binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteEncoder.of(tokenizer).encode, np.array([END_ID], "<u4").tobytes()
        for ids, texts in blocks(batches, 2 << 20):
            yield record_batch({"doc_id": ids, "ids": [encode(t) + end for t in texts]}, schema)

    return ordered.mapInArrow(run, ddl)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, block: int = BLOCK) -> None:
    """Write all documents' ids to files under ``path``, in ascending order of doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    encoded(docs, tokenizer).write.format("token_ids").option("block", block).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, task_ids: int = TASK_IDS) -> DataFrame:
    """(doc_id, start, ids): documents as the files have them, with the number of ids before each."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("task_ids", task_ids).load(path)


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token_ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_pylist()
            yield record_batch({"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]}, schema)

    return read_tokens(spark, path).mapInArrow(run, ddl)


# ---- byte-level encoding, each distinct piece of text once

#: Printable ASCII and the Latin letters below U+0180, with a space or line feed before them at most.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
LATIN = re.compile(f"[ \\n]?[!-~{_LETTERS}]*").fullmatch
#: The pre-tokenizer's items of such a piece after its letters have taken their byte-level names, which are letters or U+0100 to U+0142.
ITEMS = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00a1-\u0143]+| ?[0-9]+| ?[^\\sA-Za-z0-9\u00a1-\u0143]+").findall
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
PUNCTUATION = string.punctuation.encode()


def _latin_letter(piece: bytes) -> bool:
    """Whether a piece ends in a letter of U+0080 to U+017F."""
    last = piece[-2:].decode("utf-8", "replace")
    return len(last) == 1 and last < "\u0180" and last.isalpha()


class ByteEncoder(dict):
    """Ids of a text by encoding each distinct piece between single spaces once: a table of pieces that fills itself.

    The pre-tokenizer cuts before a single space between two other characters, and
    before and after a line feed between two others, whatever comes next.  So the ids
    of a text are those of its pieces, unless a piece begins or ends with another kind
    of white space: such texts, and texts with runs of spaces or the special token's
    name, are encoded as a whole.  Past ``most`` pieces the table begins again, which
    bounds memory and changes nothing else.
    """

    _made: dict[str, "ByteEncoder"] = {}
    #: Characters that the pre-tokenizer's pattern takes for white space, and some that others do.
    WHITE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff") | {chr(c) for c in range(0x2000, 0x200B)}

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.whole(b"\n")
        self.most = most

    @classmethod
    def of(cls, path: str | None = None) -> "ByteEncoder":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; null is empty."""
        if not text:
            return b""
        if b"  " in text or b" \n" in text or b"\n " in text or b"\n\n\n" in text or b"\0" in text or text[:1] in b" \n" or text[-1:] in b" \n" or any(s in text for s in self.special):
            return self.whole(text)
        try:  # each piece keeps the space or line feed that it begins with
            return b"".join(map(self.__getitem__, text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")))
        except KeyError:
            return self.whole(text)

    def __missing__(self, piece: bytes) -> bytes:
        """Encode a piece; KeyError if it begins or ends with white space other than its own.

        A word is one item of the pre-tokenizer, and an item always ends between a letter or
        digit and punctuation: a piece with punctuation behind it has the ids of the piece
        without it, which are looked up, and those of the punctuation.  Other pieces of
        printable ASCII and Latin letters are cut to items as the pre-tokenizer does.  Items
        go straight to the model.  All other pieces take the tokenizer's full way.
        """
        text = piece.decode("utf-8", "replace")
        inner = text[1:] if text[:1] in (" ", "\n") else text
        stem = piece.rstrip(PUNCTUATION)
        if inner.isalpha() and (inner.isascii() or max(inner) < "\u0180"):
            item = inner if inner.isascii() else inner.translate(_BYTE_NAMES)
            ids = [t.id for t in self.tokenize("\u0120" + item if text[0] == " " else item)]
            made = (self.line_feed if text[0] == "\n" else b"") + (PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes())
        elif len(stem) < len(piece) and (stem[-1:].isalnum() or _latin_letter(stem)):
            made = self[stem] + self[piece[len(stem) :]]
        elif LATIN(text):
            items = ITEMS(text if text.isascii() else text.translate(_BYTE_NAMES))
            ids = [t.id for item in items for t in self.tokenize(item.replace(" ", "\u0120"))] if piece != b"\n" else []
            made = (self.line_feed if text[0] == "\n" else b"") + (PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes())
        else:
            if not inner or inner[0] in self.WHITE or inner[-1] in self.WHITE:
                raise KeyError(piece)
            made = self.whole(piece)
        if len(self) >= self.most:
            self.clear()
        self[piece] = made
        return made
