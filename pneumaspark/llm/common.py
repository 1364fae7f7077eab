"""What the training-data operators share: Arrow batches, words, fast encoding.

Words are maximal runs of bytes other than space and ``\\t``-``\\r``; that is
what ``bytes.split()`` cuts, and ``bytes.lower()`` lower-cases A-Z only, so both
follow the contracts on UTF-8 bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TOKENIZER = "word_bpe_49k.json"
#: Rows and bytes of files up to which a written table is sent to every executor; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast only if it has at most ``rows`` rows and its files few bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else ``docs`` carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    """(doc_id, UTF-8 text) of an Arrow batch of ``id_text``."""
    return zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; to be called on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def blocks(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of consecutive rows, at most about ``most_bytes`` of text each."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in rows_of(batch):
            ids.append(doc_id)
            texts.append(text)
            held += len(text or b"") + 64
            if held >= most_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def map_docs(docs: DataFrame, per_block: Callable[[list, list], dict | None], ddl: str, most_bytes: int = 4 << 20) -> DataFrame:
    """Apply ``per_block(ids, texts)``, which returns columns by name, to bounded blocks of rows."""

    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, most_bytes):
            cols = per_block(ids, texts)
            if cols is not None:
                yield record_batch(cols, schema)

    return id_text(docs).mapInArrow(run, ddl)


def _byte_names() -> dict[int, str]:
    """Byte-level names of the letters U+0080 to U+017F: printable Latin-1 bytes name themselves, others follow from U+0100."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in itself)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}


_BYTE_NAMES = _byte_names()


def _plain(s: str) -> bool:
    """Latin lower-case letters only, at least one."""
    return s.isalpha() and s == s.lower() and max(s) < "\u0180"


class WordEncoder:
    """Token ids of a text, by encoding each distinct word once.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words one after another.  ``words`` maps a word to its
    ids as little-endian unsigned 32-bit bytes; past ``most`` entries it starts
    again, which bounds memory and changes nothing else.
    """

    _made: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.most = most

    @classmethod
    def of(cls, path: str | None = None) -> "WordEncoder":
        """The encoder of this worker process, kept from task to task."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: bytes | None) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit bytes; null is empty."""
        if not text:
            return b""
        if b"<|" not in text:  # a special token's name must keep its case
            text = text.lower()
        split, known = text.split(), self.words
        try:
            return b"".join(map(known.__getitem__, split))
        except KeyError:
            self.learn({w for w in split if w not in known})
        try:
            return b"".join(map(known.__getitem__, split))
        except KeyError:  # the table began again
            self.learn(set(split))
        return b"".join(map(known.__getitem__, split))

    def learn(self, new: set[bytes]) -> None:
        """Encode words; one that ends in a stop or comma shares the ids of the text before it.

        The pre-tokenizer leaves a word of Latin lower-case letters whole, so such a
        word goes straight to the model; all others take the tokenizer's full way.
        """
        known = self.words
        if len(known) + len(new) > self.most:
            known.clear()
        stems = {w: w[:-1] for w in new if w[-1:] in (b".", b",") and _plain(w[:-1].decode("utf-8", "replace")[-1:])}
        tokenize, rest = self.tokenizer.model.tokenize, [b".", b","]
        for w in {stems.get(w, w) for w in new}:
            plain = w.decode("utf-8", "replace")
            if _plain(plain):
                known[w] = np.array([t.id for t in tokenize(plain.translate(_BYTE_NAMES) if not plain.isascii() else plain)], "<u4").tobytes()
            else:
                rest.append(w)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(rest, encoded, strict=True))
        known.update((w, known[stem] + known[w[-1:]]) for w, stem in stems.items())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), on unsigned arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash:
    """64-bit hashes of words, each distinct word hashed once per worker."""

    _made: "WordHash | None" = None

    def __init__(self, most: int = 500_000):
        self.words: dict[bytes, bytes] = {}
        self.most = most

    @classmethod
    def of(cls) -> "WordHash":
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def __call__(self, split: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.words
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, split)), np.uint64)
        except KeyError:
            new = {w for w in split if w not in known}
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(split)
            digest = xxhash.xxh3_64_digest
            known.update((w, digest(w)) for w in new)
            return np.frombuffer(b"".join(map(known.__getitem__, split)), np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):  # linear in random word hashes, so mixing once at the end is enough
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[j : j + n]
    return mix64(h)
