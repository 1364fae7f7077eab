"""Language-model scores from a causal self-attention model, trained in numpy.

The model reads subword ids and predicts the next one in three factors: a group of
classes and a class in it from the context, and the id within the class from corpus
counts.  The most frequent ids are classes of their own; the others share classes of
like frequency.  The layer's outputs add to the log frequencies of groups and classes
after the class before; within a class, ids after the end of a word and others are
counted apart.  One attention layer with a residual path looks back over a window of ids.

1. One pass over the documents writes every document's ids and, of the training documents,
   distinct words with their counts.  A word is looked up once for both, by a number.  No later pass tokenizes.
2. Ids, and how often a class follows another, are counted over all ids of all training
   documents and their ends.
3. The model trains on every id of every training document: texts with begin and end
   are cut to windows of ``CONTEXT`` inputs, the last one filled up and masked.  The
   documents are dealt to rounds that grow; in a round every task trains a copy on the
   documents of its partition as they stream by, and the copies' mean starts the next
   round.  Means are taken in tasks, file by file, until few rows are left for the driver.
4. The written ids of all documents are scored in windows that overlap: each id is scored once, with
   at least ``CONTEXT - STRIDE`` ids before it where the document has them.  Scores meet the rows by the hash of id and text.

The base score is a word unigram with add-one counts.  Counts of the most frequent
words are broadcast (``FREQUENT`` at most); a second pass over the documents sums them and writes the
hashes of the other words, which meet their counts in a join, where no key is hot.

Documents whose crc32 of the doc_id as text has remainder 2 by 7 are held out.  Null
and empty texts have the end alone.  A null doc_id counts as the text "null".  Rows
that share a doc_id are scored each, in rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import WordEncoder, arrow_schema, id_text, record_batch
from pneumaspark.session import materialize

FOLDS, HELD_OUT = 7, 2
CONTEXT, STRIDE = 32, 24
WIDTH = 24
#: Classes are dealt to groups; of a group's classes, SHARED hold several ids.
GROUPS, GROUP_CLASSES, SHARED = 32, 32, 4
EMBEDDED, HASHED = 1536, 512
#: Fills windows that a text's end cuts short; trained with weight 0.
PAD, BEGIN = -2, -1
#: Sixteenths of the training documents that the rounds take, one after another.
ROUNDS = (1, 3, 12)
#: In the last round a task with few windows goes over them again, until it has made so many steps, but not more often than this.
STEPS, PASSES = 600, 4
BATCH = 128
RATE = 2e-2
#: Rows of weights that reach the driver at most.
MOST_COPIES = 64
FREQUENT = 50_000
#: Of Spark's xxhash64.
HASH_SEED = 42
#: Words that a worker numbers at once, and bytes of texts that it encodes together.
WORDS, BLOCK_BYTES = 1_000_000, 4 << 20
END = b""
#: The ids of word_bpe_49k fit 16 bits, and so does the end behind them.
ID = "<u2"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-case words and the end, which is the empty string."""
    return [*(text or b"").lower().split(), END]


class Vocabulary:
    """Classes, within-class log probabilities and embedding rows of subword ids, from their corpus counts."""

    def __init__(self, counts: np.ndarray, ends: np.ndarray):
        """``counts[after, id]``: after = 1 where the id before ends a word; the last id is the end of a text."""
        n = counts.shape[1]
        both = counts + 0.02
        smooth = both.sum(axis=0)
        self.ends = np.append(ends, True).astype(np.int8)
        self.n_classes = GROUPS * GROUP_CLASSES
        order = np.argsort(-smooth, kind="stable")
        own = min(n, GROUPS * (GROUP_CLASSES - SHARED))
        number = np.empty(n, np.int32)  # by frequency; the groups get classes in turn
        number[order[:own]] = np.arange(own)
        rest = order[own:]
        if len(rest):
            mass = np.cumsum(smooth[rest])
            number[rest] = own + np.minimum((mass / mass[-1] * GROUPS * SHARED).astype(int), GROUPS * SHARED - 1)
        self.of_class = number % GROUPS * GROUP_CLASSES + number // GROUPS
        total = np.array([np.bincount(self.of_class, c, self.n_classes) for c in both])
        self.log_within = np.log(both / total[:, self.of_class]).astype(np.float32)
        self.log_class = np.log(np.maximum(total, 1e-9) / total.sum(axis=1, keepdims=True)).astype(np.float32)
        self.row = np.empty(n, np.int32)
        self.row[order] = np.where(np.arange(n) < EMBEDDED, np.arange(n), EMBEDDED + order % HASHED)
        self.begin = EMBEDDED + HASHED
        self.end = n - 1
        # the class before an output; the begin of a text has a number of its own, behind the classes
        ended = np.bincount(self.of_class, smooth * self.ends, self.n_classes) > 0.5 * total.sum(axis=0)
        self.prior = np.exp(np.concatenate([self.log_class[ended.astype(int)], self.log_class[1:]]))
        self.log_next = np.log(self.prior).astype(np.float32)

    def count_next(self, counts: np.ndarray, smoothing: float = 2.0) -> None:
        """Take in counts[class before, class], smoothed by what follows the end or the middle of a word.

        A class before that has many classes behind it leaves more to the smoothing.
        """
        weight = smoothing * np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
        self.log_next = np.log((counts + weight * self.prior) / (counts.sum(axis=1, keepdims=True) + weight)).astype(np.float32)

    def inputs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows and classes of ids, among which BEGIN may be."""
        known = np.maximum(ids, 0)
        begin = ids == BEGIN
        return np.where(begin, self.begin, self.row.take(known)), np.where(begin, self.n_classes, self.of_class.take(known))


class Model:
    """x = E[id] + P[place]; h = x + softmax(mask(x Q K' x')) x V O; a group of classes by
    softmax(h U + log frequency of groups after the class before), a class in it by another softmax alike."""

    def __init__(self, weights: dict[str, np.ndarray], log_next: np.ndarray):
        self.w = {k: v.copy() for k, v in weights.items()}
        inner = log_next.reshape(len(log_next), GROUPS, GROUP_CLASSES)
        top = inner.max(axis=2, keepdims=True)
        total = np.log(np.exp(inner - top).sum(axis=2, keepdims=True)) + top
        # groups first: rows in the order of their groups read one group's table after another
        self.next_group, self.next_inner = total[:, :, 0], np.ascontiguousarray((inner - total).transpose(1, 0, 2))

    @staticmethod
    def fresh(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
        r = np.random.default_rng(7)
        make = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        weights = {"E": make(vocabulary.begin + 1, WIDTH) * 3, "P": make(CONTEXT, WIDTH), "QKV": make(WIDTH, 3 * WIDTH) * 2, "O": make(WIDTH, WIDTH) * 2}
        return weights | {"U": make(WIDTH, GROUPS) * np.float32(0.1), "C": make(GROUPS, WIDTH, GROUP_CLASSES) * np.float32(0.1)}

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Q K' with its scale, and V O: the layer is x + softmax(mask(x M x')) x N."""
        q, k, v = (self.w["QKV"][:, a : a + WIDTH] for a in (0, WIDTH, 2 * WIDTH))
        return q @ k.T * q.dtype.type(WIDTH**-0.5), v @ self.w["O"]

    def states(self, rows: np.ndarray, skip: int = 0, folded: tuple | None = None) -> tuple:
        """Hidden states after each place of windows of embedding rows, from place ``skip`` on, and what the gradient needs."""
        w, (n, length) = self.w, rows.shape
        m, v = folded or self.folded()
        x = w["E"].take(rows, axis=0)
        x += w["P"][:length]
        given = x[:, skip:]
        t = (given.reshape(-1, WIDTH) @ m).reshape(given.shape)
        s = t @ x.transpose(0, 2, 1)
        if s.max(initial=0) > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= np.tri(length, dtype=s.dtype)[skip:]
        s /= (s.reshape(-1, length) @ np.ones(length, s.dtype)).reshape(n, length - skip, 1)
        o = s @ x
        h = (o.reshape(-1, WIDTH) @ v).reshape(given.shape)
        h += given
        return h, x, t, s, o

    @staticmethod
    def spread(z: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of the wanted column of rows of logits, and exponentials with their sums."""
        picked = z.ravel().take(np.arange(len(z)) * z.shape[1] + wanted)
        ones = np.ones(z.shape[1], z.dtype)
        with np.errstate(over="ignore"):
            e = np.exp(z)
            total = e @ ones
        if not (np.isfinite(total).all() and total.min() > 1e-30):
            top = z.max(axis=1)
            e = np.exp(z - top[:, None])
            total = e @ ones
            picked = picked - top
        return picked - np.log(total), e, total

    def outputs(self, h: np.ndarray, before: np.ndarray, classes: np.ndarray) -> tuple:
        """Rows in the order of their groups: the order, group edges, states, groups, classes in them, log probabilities and what both softmaxes are made of."""
        group = (classes // GROUP_CLASSES).astype(np.int16)
        order = np.argsort(group, kind="stable")
        h, before, classes = h.take(order, axis=0), before.take(order), classes.take(order)
        group = group.take(order).astype(np.int64)
        slot = classes - group * GROUP_CLASSES
        z = h @ self.w["U"]
        z += self.next_group.take(before, axis=0)
        first, *p = self.spread(z, group)
        edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        y = np.empty_like(z)
        for g in range(GROUPS):
            a, b = edges[g], edges[g + 1]
            if a < b:
                np.matmul(h[a:b], self.w["C"][g], out=y[a:b])
        y += self.next_inner.reshape(-1, GROUP_CLASSES).take(group * len(self.next_group) + before, axis=0)
        second, *q = self.spread(y, slot)
        return order, edges, h, group, slot, first + second, p, q

    def log_probabilities(self, h: np.ndarray, before: np.ndarray, classes: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log probability of each wanted class, for states in rows and the classes before."""
        out = np.empty(len(h))
        for a in range(0, len(h), rows):
            order, *_, found, _, _ = self.outputs(h[a : a + rows], before[a : a + rows], classes[a : a + rows])
            out[a + order] = found
        return out

    def gradient(self, rows: np.ndarray, before: np.ndarray, classes: np.ndarray, use: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradient of the mean loss over the places in ``use`` (all by default)."""
        w, n = self.w, rows.size
        m, v = folded = self.folded()
        h, x, t, a, o = self.states(rows, folded=folded)
        order, edges, hs, group, slot, _, (p, p_sum), (c, c_sum) = self.outputs(h.reshape(n, WIDTH), before.ravel(), classes.ravel())
        scale = np.full(n, 1 / n, p.dtype) if use is None else (use.ravel().take(order) / max(1, int(use.sum()))).astype(p.dtype)
        every = np.arange(n) * p.shape[1]
        p *= (scale / p_sum)[:, None]
        c *= (scale / c_sum)[:, None]
        p.ravel()[every + group] -= scale
        c.ravel()[every + slot] -= scale
        g = {"U": hs.T @ p, "C": np.zeros_like(w["C"])}
        ds = p @ w["U"].T
        inner = np.empty_like(ds)
        for k_group in range(GROUPS):
            i, j = edges[k_group], edges[k_group + 1]
            if i < j:
                np.matmul(hs[i:j].T, c[i:j], out=g["C"][k_group])
                np.matmul(c[i:j], w["C"][k_group].T, out=inner[i:j])
        ds += inner
        back = np.empty_like(order)
        back[order] = np.arange(n)
        dh = ds.take(back, axis=0)
        flat = x.reshape(n, WIDTH)
        do = (dh @ v.T).reshape(x.shape)
        da = do @ x.transpose(0, 2, 1)
        da -= ((da * a).reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)).reshape(*rows.shape, 1)
        da *= a
        dt = (da @ x).reshape(n, WIDTH)
        dx = a.transpose(0, 2, 1) @ do
        dx += da.transpose(0, 2, 1) @ t
        dx = dx.reshape(n, WIDTH)
        dx += dt @ m.T
        dx += dh
        dm, dv = flat.T @ dt, o.reshape(n, WIDTH).T @ dh
        dm *= dm.dtype.type(WIDTH**-0.5)
        query, key, value = (w["QKV"][:, i : i + WIDTH] for i in (0, WIDTH, 2 * WIDTH))
        g["QKV"] = np.concatenate([dm @ key, dm.T @ query, dv @ w["O"].T], axis=1)
        g["O"] = value.T @ dv
        g["P"] = np.zeros_like(w["P"])
        g["P"][: rows.shape[1]] = dx.reshape(h.shape).sum(axis=0)
        by_row = np.argsort(rows.ravel().astype(np.int16), kind="stable")  # 16 bits sort by radix
        sorted_rows = rows.ravel().take(by_row)
        first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
        g["E"] = np.zeros_like(w["E"])
        g["E"][sorted_rows[first]] = np.add.reduceat(dx.take(by_row, axis=0), first, axis=0)
        return g

    def step(self, windows: np.ndarray, vocabulary: Vocabulary, moments: dict, rate: float) -> None:
        """A step of Adam over windows of ids; ``moments`` carries its state and the number of steps."""
        given, wanted = windows[:, :-1], windows[:, 1:]
        rows, before = vocabulary.inputs(given)
        g = self.gradient(rows, before, vocabulary.of_class.take(np.maximum(wanted, 0)), wanted != PAD)
        done = moments["steps"] = moments.get("steps", 0) + 1
        now = rate * min(1, done / 20) / (1 + done / 400) ** 0.5
        for k, w in self.w.items():
            m, s = moments.setdefault(k, (np.zeros_like(w), np.zeros_like(w)))
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            move = m / (np.sqrt(s / (1 - 0.99**done)) + 1e-8)
            move *= -now / (1 - 0.9**done)
            w += move.astype(w.dtype, copy=False)

    def train(self, stream: Iterable[np.ndarray], vocabulary: Vocabulary, rate: float = RATE, passes: int = PASSES) -> int:
        """Train on a stream of arrays of windows of ids, each taken once; few of them are taken again, at most ``passes`` times in all.

        Returns the number of windows.
        """
        moments: dict = {}
        r, n = np.random.default_rng(11), 0
        few: list[np.ndarray] = []
        for windows in stream:
            if n < STEPS * BATCH:
                few.append(windows)
            n += len(windows)
            self.epoch(windows[r.permutation(len(windows))], vocabulary, moments, rate)
        if 0 < n < STEPS * BATCH:
            held = np.concatenate(few)
            for _ in range(min(passes, round(STEPS * BATCH / n)) - 1):
                self.epoch(held[r.permutation(n)], vocabulary, moments, rate)
        return n

    def epoch(self, windows: np.ndarray, vocabulary: Vocabulary, moments: dict, rate: float) -> None:
        for at in range(0, len(windows), BATCH):
            self.step(windows[at : at + BATCH], vocabulary, moments, rate)

    def score(self, ids: list[np.ndarray], vocabulary: Vocabulary, batch: int = 340) -> list[float]:
        """Natural-log probability of each text's ids and its end.

        The texts' windows of CONTEXT inputs go through the layer in batches; a
        window scores the outputs that no window before it has.
        """
        sizes = np.array([len(i) + 1 for i in ids])
        base = np.cumsum(sizes) - sizes
        every = np.concatenate([part for i in ids for part in ([BEGIN], i)]).astype(np.int32)
        wanted = np.append(every[1:], vocabulary.end)
        wanted[base[1:] - 1] = vocabulary.end
        inputs, before = vocabulary.inputs(every)
        after = np.where(every == BEGIN, 1, vocabulary.ends[np.maximum(every, 0)])
        classes = vocabulary.of_class[wanted]
        n_more = np.maximum(0, -(-(sizes - CONTEXT) // STRIDE))
        doc = np.repeat(np.arange(len(ids)), n_more + 1)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n_more + 1) - (n_more + 1), n_more + 1)
        start = base[doc] + number * STRIDE
        stop = np.minimum(start + CONTEXT, base[doc] + sizes[doc])
        fresh = np.where(number > 0, CONTEXT - STRIDE, 0)
        place = np.arange(CONTEXT)
        out = np.zeros(len(inputs))
        short = stop - start
        for skip in (0, CONTEXT - STRIDE):
            alike = np.flatnonzero(fresh == skip)
            alike = alike[np.argsort(short[alike], kind="stable")]
            for at in range(0, len(alike), batch):
                some = alike[at : at + batch]
                length = int(short[some].max())
                cells = start[some][:, None] + place[:length]
                h = self.states(inputs[np.minimum(cells, len(inputs) - 1)], skip)[0]
                cells = cells[:, skip:]
                use = cells < stop[some][:, None]
                cells = cells[use]
                out[cells] = self.log_probabilities(h[use], before[cells], classes[cells])
        out += vocabulary.log_within[after, wanted]
        return np.add.reduceat(out, base).tolist()


def windows_of(coded: list[np.ndarray], end: int) -> np.ndarray:
    """Windows of CONTEXT + 1 ids of texts, each with its begin and ``end``; every id and end is the target of one.

    The last id of a window begins the next; PAD fills what is behind an end.
    """
    sizes = np.array([len(c) + 2 for c in coded])
    every = np.concatenate([part for c in coded for part in ([BEGIN], c, [end])]).astype(np.int32)
    base = np.cumsum(sizes) - sizes
    n_windows = -(-(sizes - 1) // CONTEXT)
    doc = np.repeat(np.arange(len(coded)), n_windows)
    start = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * CONTEXT
    cells = start[:, None] + np.arange(CONTEXT + 1)
    return np.where(cells < (base + sizes)[doc][:, None], every[np.minimum(cells, len(every) - 1)], PAD)


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): rows of equal id and text have one key."""
    return id_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))


class WordNumbers:
    """Numbers, ids and counts of the words of this worker's texts: a word is looked up once for its ids and its count.

    ``number`` maps a word to its number in 4 bytes; the ids of word k are ``flat[start[k] : start[k] + length[k]]``.
    Once there are ``most`` words, the caller takes the counts and clears the table before the next block.
    """

    _made: "WordNumbers | None" = None

    def __init__(self, encoder: WordEncoder, most: int = WORDS):
        self.encoder, self.most = encoder, most
        self.clear()

    @classmethod
    def of(cls) -> "WordNumbers":
        """The numbers of this worker process, kept from task to task; counts begin at nothing."""
        cls._made = cls._made or cls(WordEncoder.of())
        cls._made.counts[:] = 0
        return cls._made

    def clear(self) -> None:
        self.number: dict[bytes, bytes] = {}
        self.words: list[bytes] = []
        self.flat, self.n_flat = np.empty(1 << 16, ID), 0
        self.start, self.length, self.counts = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def learn(self, new: set[bytes]) -> None:
        """Number words; the encoder's own table gives them up again."""
        self.encoder.learn(new)
        made = list(new)
        ids = [self.encoder.words[w] for w in made]
        self.encoder.words.clear()
        first, end = len(self.words), len(self.words) + len(made)
        packed = np.arange(first, end, dtype="<u4").tobytes()
        self.number.update((w, packed[k : k + 4]) for w, k in zip(made, range(0, len(packed), 4), strict=True))
        self.words += made
        while len(self.start) < end:
            self.start, self.length, self.counts = (np.append(x, np.zeros_like(x)) for x in (self.start, self.length, self.counts))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        every = np.frombuffer(b"".join(ids), "<u4")
        while len(self.flat) < self.n_flat + len(every):
            self.flat = np.append(self.flat, np.empty_like(self.flat))
        self.flat[self.n_flat : self.n_flat + len(every)] = every
        self.length[first:end] = length
        self.start[first:end] = self.n_flat + np.cumsum(length) - length
        self.n_flat += len(every)

    def take(self, splits: list[list[bytes]], train: list[bool]) -> list[bytes]:
        """Ids of each text from its words; the words of training texts are counted."""
        known = self.number
        packed = []
        for split in splits:
            try:
                packed.append(b"".join(map(known.__getitem__, split)))
            except KeyError:
                self.learn({w for w in split if w not in known})
                packed.append(b"".join(map(known.__getitem__, split)))
        counted = np.frombuffer(b"".join([x for x, use in zip(packed, train, strict=True) if use]), "<u4")
        found = np.bincount(counted)
        self.counts[: len(found)] += found
        every = np.frombuffer(b"".join(packed), "<u4")
        length = self.length.take(every)
        stop = np.append(0, np.cumsum(length))
        ids = self.flat.take(np.repeat(self.start.take(every) - stop[:-1], length) + np.arange(stop[-1]))
        edges = stop[np.append(0, np.cumsum([len(s) for s in splits], dtype=np.int64))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def counted(self, rows: int = 200_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Counted words and their counts, which begin again."""
        seen = np.flatnonzero(self.counts)
        for at in range(0, len(seen), rows):
            some = seen[at : at + rows]
            yield [self.words[k] for k in some.tolist()], self.counts[some]
        self.counts[:] = 0


def gather(docs: DataFrame, held_out: bool = False) -> DataFrame:
    """Written (kind, key, n) of the training documents: distinct words of texts that follow each other with their counts n, each document's ids with its key as n.

    ``kind`` is "word", or "ids" and the round that trains on the document.  With ``held_out`` the ids of documents that are held out come too, as "held".
    """
    schema = arrow_schema("kind string, key binary, n long")
    rounds = np.repeat(np.arange(len(ROUNDS)), ROUNDS).tolist()

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n_train = WordNumbers.of(), 0

        def words() -> Iterator[pa.RecordBatch]:
            for some, n in numbers.counted():
                yield record_batch({"kind": ["word"] * len(some), "key": some, "n": n}, schema)

        for texts, keys, train in blocks_of(batches, held_out):
            lowered = [t.lower() for t in texts]
            splits = [t.split() for t in lowered]
            if len(numbers.words) >= numbers.most:
                yield from words()
                numbers.clear()
            coded = numbers.take(splits, train)
            for k, low in enumerate(lowered):
                if b"<|" in low:  # a special token's name must keep its case
                    coded[k] = np.frombuffer(numbers.encoder.encode(texts[k]), "<u4").astype(ID).tobytes()
            n_train += sum(train)
            kinds = [f"ids{rounds[zlib.crc32(c) % len(rounds)]}" if use else "held" for c, use in zip(coded, train, strict=True)]
            yield record_batch({"kind": kinds, "key": coded, "n": keys}, schema)
        yield from words()
        if n_train:
            yield record_batch({"kind": ["word"], "key": [END], "n": [n_train]}, schema)

    return materialize(with_key(docs).mapInArrow(collect, "kind string, key binary, n long"), "gathered", "kind")


def blocks_of(batches: Iterable[pa.RecordBatch], held_out: bool) -> Iterator[tuple[list[bytes], list[int], list[bool]]]:
    """Texts, keys and whether they train, in blocks of about BLOCK_BYTES; without ``held_out``, texts that train alone."""
    texts: list[bytes] = []
    keys: list[int] = []
    train: list[bool] = []
    size = 0
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            batch = big.slice(at, 1000)
            for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held = is_held_out(doc_id)
                if held and not held_out:
                    continue
                texts.append(text or b"")
                keys.append(key)
                train.append(not held)
                size += len(text or b"") + 64
                if size >= BLOCK_BYTES:
                    yield texts, keys, train
                    texts, keys, train, size = [], [], [], 0
    if texts:
        yield texts, keys, train


def coded_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The documents' ids, from a batch of the column ``key``."""
    return [np.frombuffer(c, ID) for c in batch.column(0).to_pylist()]


def counted(coded: DataFrame, size: int, places) -> np.ndarray:
    """Counts of the ``size`` places to which ``places(documents' ids)`` maps ids, over all documents; a task holds one array."""
    schema = arrow_schema("place int, n long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                total += np.bincount(places(coded_of(batch.slice(at, 1000))), minlength=size)
        seen = np.flatnonzero(total)
        yield record_batch({"place": seen, "n": total[seen]}, schema)

    rows = coded.select("key").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


def id_counts(coded: DataFrame, ends: np.ndarray) -> np.ndarray:
    """Counts[after, id] of subword ids over all training documents, the end of a text behind them."""
    n = len(ends) + 1
    ended = np.append(ends, 1).astype(np.int64)

    def places(docs: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate([part for c in docs for part in (c, [n - 1])]).astype(np.int64)
        return np.append(1, ended[every[:-1]]) * n + every  # a text begins after an end

    return counted(coded, 2 * n, places).reshape(2, n)


def class_pairs(coded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts[class before, class] over all ids of all training documents and their ends; the begin is the last class before."""
    n, end, of_class = vocabulary.n_classes, vocabulary.end, vocabulary.of_class

    def places(docs: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate([part for c in docs for part in (c, [end])]).astype(np.int64)
        classes = of_class[every].astype(np.int64)
        before = np.append(n, np.where(every[:-1] == end, n, classes[:-1]))
        return before * n + classes

    return counted(coded, (n + 1) * n, places).reshape(n + 1, n)


def mean_weights(copies: DataFrame, size: int) -> np.ndarray | None:
    """The mean of the copies' weights (n, weights), weighted by windows: in tasks first, while there are many."""
    schema = arrow_schema("n long, weights binary")

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(packed, "<f4") * k
                n += k
        if n:
            yield record_batch({"n": [n], "weights": [(total / n).astype("<f4").tobytes()]}, schema)

    while copies.count() > MOST_COPIES:
        copies = materialize(copies.coalesce(max(1, copies.rdd.getNumPartitions() // 16)).mapInArrow(mean, "n long, weights binary"), "copies")
    got = copies.collect()
    return sum(np.frombuffer(r.weights, "<f4") * r.n for r in got) / sum(r.n for r in got) if got else None


def train_model(gathered: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after the rounds of training."""
    spark = gathered.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    weights = Model.fresh(vocabulary)
    names, schema = list(weights), arrow_schema("n long, weights binary")

    def trainer(held, rate: float, passes: int):
        def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
            coded, size = [], 0
            for batch in batches:
                for c in coded_of(batch):
                    coded.append(c)
                    size += len(c) + 2
                    if size >= 1_000_000:
                        yield windows_of(coded, known.value.end)
                        coded, size = [], 0
            if coded:
                yield windows_of(coded, known.value.end)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(held.value, known.value.log_next)
            n = model.train(windows(batches), known.value, rate, passes)
            if n:
                yield record_batch({"n": [n], "weights": [b"".join(model.w[k].astype("<f4").tobytes() for k in names)]}, schema)

        return run

    for k in range(len(ROUNDS)):
        held = spark.sparkContext.broadcast(weights)
        share = gathered.where(F.col("kind") == f"ids{k}").select("key")
        copies = materialize(share.mapInArrow(trainer(held, RATE * 0.6**k, PASSES if k == len(ROUNDS) - 1 else 1), "n long, weights binary"), "copies")
        flat, at = mean_weights(copies, sum(w.size for w in weights.values())), 0
        if flat is not None:
            new = {}
            for name in names:
                size = weights[name].size
                new[name] = flat[at : at + size].reshape(weights[name].shape).astype(np.float32)
                at += size
            weights = new
        held.unpersist()
    return weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    numbered = with_key(docs)
    gathered = gather(docs, held_out=True)
    coded = gathered.where("kind LIKE 'ids%'")
    words = gathered.where("kind = 'word'").groupBy("key").agg(F.sum("n").alias("n"))
    words = materialize(words.select("key", F.xxhash64("key").alias("h"), "n"), "word_counts")
    n_train, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = float(np.log10(n_train + distinct + 1))
    frequent = words.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toPandas()
    table = spark.sparkContext.broadcast(dict(zip(map(bytes, frequent["key"]), np.log10(frequent["n"] + 1.0).tolist(), strict=True)))

    tokenizer = WordEncoder.of().tokenizer
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for name, number in tokenizer.get_vocab(with_added_tokens=True).items():
        ends[number] = name.endswith(("</w>", "|>"))
    vocabulary = Vocabulary(id_counts(coded, ends), ends)
    vocabulary.count_next(class_pairs(coded, vocabulary))
    weights = train_model(gathered, vocabulary)
    model = spark.sparkContext.broadcast((vocabulary, weights))

    ddl = "doc_id long, doc_key long, held_out boolean, n_tokens long, known long, known_sum double, rare array<long>"
    schema, score_schema = arrow_schema(ddl), arrow_schema("doc_key long, score double")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row the sum over its frequent words, and the hashes of its other words as Spark's xxhash64 has them."""
        from xxhash import xxh64_intdigest

        known = table.value.get
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                ids, tokens = batch.column(0).to_pylist(), [tokens_of(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                sums, n_known, rare = [], [], []
                for ws in tokens:
                    found = list(map(known, ws, repeat(0.0)))  # a count's logarithm isn't 0
                    left = [xxh64_intdigest(w, HASH_SEED) for w, f in zip(ws, found, strict=True) if not f]
                    rare.append(np.array(left, np.uint64).view(np.int64))
                    sums.append(sum(found))
                    n_known.append(len(ws) - len(left))
                cols = {"doc_id": ids, "doc_key": batch.column(2), "held_out": [is_held_out(i) for i in ids], "n_tokens": [len(ws) for ws in tokens]}
                yield record_batch(cols | {"known": n_known, "known_sum": sums, "rare": rare}, schema)

    rows = materialize(numbered.mapInArrow(meet, ddl), "base_sums")
    # a word's hash is a key once among the counts, so no key is hot
    asked = rows.select("doc_key", F.explode("rare").alias("h"))
    met = asked.join(words.select("h", "n").hint("shuffle_hash"), "h")
    sums = met.groupBy("doc_key").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("rare_sum"), F.count(F.lit(1)).alias("rare_known"))
    # rows that repeat a text meet the counts once
    copies = rows.groupBy("doc_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sums = sums.join(copies, "doc_key", "left").select("doc_key", (F.col("rare_sum") / F.coalesce("copies", F.lit(1))).alias("rare_sum"), (F.col("rare_known") / F.coalesce("copies", F.lit(1))).cast("long").alias("rare_known"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = model.value
        net = Model(weights, vocabulary.log_next)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                yield record_batch({"doc_key": batch.column(1), "score": np.array(net.score(coded_of(batch), vocabulary)) / np.log(10)}, score_schema)

    scores = gathered.where("kind <> 'word'").select("key", "n").mapInArrow(score, "doc_key long, score double")
    scores = scores.groupBy("doc_key").agg(F.max("score").alias("score"))  # rows that repeat have one score
    scored = rows.drop("rare").join(sums, "doc_key", "left").join(scores, "doc_key")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )
