"""N-gram Jaccard self-join with several global token orders.

A document's set holds the hashes of its distinct 5-word shingles.  Two sets that
reach similarity 0.8 share a token among the first ``n - ceil(0.8 n) + 1`` of each
under any order of all tokens.  Postings are made under the first order, in which
tokens that many sets have come last; a candidate pair must also share a prefix
token under each further order before its sets are compared.  Before any text
moves, a bound drops pairs: sets are counted by ranges of the token hash, and the
smaller counts of the ranges add up to no less than what two sets share.

1. Equal sets become one class, which the smallest doc_id stands for.
2. Token frequencies over all classes are counted exactly on 32-bit hashes, which
   tasks send as packed differences; the most frequent make the heavy tokens.
   They steer the order only: any order gives the same links.
3. Prefix tokens are grouped.  Every list links its members to its first one; the
   pairs are verified, and the links' components are found.
4. Lists whose members lie in one component are settled.  In the others, members
   of different components pair up, if the list is short; the members of long
   lists, which must consist of heavy tokens, are verified in blocks of documents
   against blocks, by inverted lists inside a task, which returns links between
   components only.
5. Components of all links are spread to the members of each class.

Words are runs of bytes other than blanks after A-Z is lower-cased.  A text of
fewer than five words has its whole sequence as one shingle; null and empty texts
have empty sets, which link with nothing.  Texts that share a doc_id are compared under
ids of their own; their components are then one, with the links of each.  A null doc_id
is a vertex of its own that links with nothing and has a null component.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import WordHash, arrow_schema, blocks, id_text, map_docs, mix64, record_batch, shingle_hashes, small as small_table
from pneumaspark.llm.components import components
from pneumaspark.session import materialize

SHINGLE = 5
PERCENT = 80
#: Seeds of the further orders.
ORDERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: A token is heavy if more classes than this have it; a list is long beyond the same size.
LONG = 48
#: At most so many heavy tokens steer the order (4 MB as 32-bit hashes).
MOST_HEAVY = 1_000_000
#: Documents in a block of the long lists' verification.
BLOCK_DOCS = 512
COUNT_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A written table of a long or two, marked for broadcast only if it is small."""
    return small_table(df, 1_000_000)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = WordHash.of()((text or b"").lower().split())
    h = np.sort(shingle_hashes(words, min(SHINGLE, max(1, len(words)))))
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common) and common > 0


def classes(docs: DataFrame) -> DataFrame:
    """Written (doc_id, n_shingles, d1, d2, counts): the set's size, 128 bits of its content, and counts by hash range."""

    def digest(ids: list, texts: list) -> dict:
        sets = [shingles(t) for t in texts]
        with np.errstate(over="ignore"):
            d1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            d2 = [int(mix64(s ^ np.uint64(ORDERS[0])).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "d1": d1, "d2": d2, "counts": [range_counts(s) for s in sets]}

    return materialize(map_docs(docs, digest, "doc_id long, n_shingles long, d1 long, d2 long, counts binary"), "sets")


def range_counts(tokens: np.ndarray) -> bytes:
    """Tokens in each of 2**k ranges of the hash, four to eight to a range on average, a byte each (255 stands for more)."""
    k = max(0, (len(tokens) // 4).bit_length() - 1)
    if not k:
        return bytes([min(len(tokens), 255)])
    return np.minimum(np.bincount((tokens >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> float:
    """Upper bound of the tokens that two sets share, from their counts by range."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if max(x.max(), y.max()) == 255:
        return float("inf")
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose counts by range leave the similarity in reach, written."""
    schema = arrow_schema("a long, b long")
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("counts").alias(f"c_{name}"))
    with_counts = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "c_a", "c_b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
            good = [(a, b) for a, b, n, m, x, y in rows if (100 + PERCENT) * most_common(x, y) >= PERCENT * (n + m)]
            yield record_batch({"a": [g[0] for g in good], "b": [g[1] for g in good]}, schema)

    return materialize(with_counts.mapInArrow(check, "a long, b long").distinct(), "possible_pairs")


def heavy_tokens(docs: DataFrame, buckets: int) -> np.ndarray:
    """Sorted 32-bit hashes of the tokens that more than ``LONG`` documents have, the most frequent if there are too many."""
    packed_schema, count_schema = arrow_schema("bucket int, packed binary"), arrow_schema("token long, times long")

    def count_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, COUNT_BYTES):
            tokens = [(shingles(t) >> np.uint64(32)).astype(np.uint32) for t in texts]
            values, times = np.unique(np.concatenate(tokens), return_counts=True)
            edges = np.searchsorted(values, (np.arange(1, buckets) * (2**32 // buckets)).astype(np.uint32))
            out: dict[str, list] = {"bucket": [], "packed": []}
            for b, (v, n) in enumerate(zip(np.split(values, edges), np.split(times, edges), strict=True)):
                if len(v):  # first the value, then differences of 16 bits; 65535 carries on; times follow where over one
                    gaps = np.diff(v, prepend=v[:1]).astype(np.int64)
                    carry = gaps // 65535
                    coded = np.full(len(gaps) + int(carry.sum()), 65535, np.uint16)
                    coded[np.arange(len(gaps)) + np.cumsum(carry)] = gaps % 65535
                    several = np.flatnonzero(n > 1)
                    head = np.array([v[0], len(coded), len(several)], np.uint32).tobytes()
                    out["bucket"].append(b)
                    out["packed"].append(head + coded.tobytes() + several.astype(np.uint32).tobytes() + n[several].astype(np.uint32).tobytes())
            yield record_batch(out, packed_schema)

    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        first, n_coded, n_several = np.frombuffer(data, np.uint32, 3).tolist()
        coded = np.frombuffer(data, np.uint16, n_coded, 12).astype(np.int64)
        values = first + np.cumsum(coded)[coded != 65535]
        times = np.ones(len(values), np.int64)
        at = np.frombuffer(data[12 + 2 * n_coded :], np.uint32, 2 * n_several)
        times[at[:n_several]] = at[n_several:]
        return values, times

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[b].append(unpack(data))
                if len(held[b]) >= 64:  # sums so far, so memory follows the distinct tokens
                    held[b] = [summed(held[b])]
        for parts in held.values():
            values, times = summed(parts)
            often = times > LONG
            yield record_batch({"token": values[often], "times": times[often]}, count_schema)

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(inverse, np.concatenate([t for _, t in parts])).astype(np.int64)

    counted = id_text(docs).mapInArrow(count_block, "bucket int, packed binary").repartition("bucket").mapInArrow(total, "token long, times long")
    rows = counted.orderBy(F.desc("times"), "token").limit(MOST_HEAVY).select("token").toPandas()
    return np.sort(rows["token"].to_numpy().astype(np.uint32))


def prefix(tokens: np.ndarray, heavy: np.ndarray, seed: int = 0) -> np.ndarray:
    """The prefix of a set: heavy tokens last, otherwise by a seeded hash."""
    rank = mix64(tokens ^ np.uint64(seed)) if seed else tokens
    if len(heavy) and len(tokens):
        short = (tokens >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)
        rank = (rank >> np.uint64(1)) | ((heavy[at] == short).astype(np.uint64) << np.uint64(63))
    k = prefix_size(len(tokens)) if len(tokens) else 0
    return tokens[np.argpartition(rank, k - 1)[:k]] if 0 < k < len(tokens) else tokens


class Sets:
    """Sets and further prefixes of the documents a task looks at again and again."""

    def __init__(self, heavy: np.ndarray, most: int = 4_000_000):
        self.heavy, self.most, self.held, self.sets = heavy, most, 0, {}

    def get(self, doc: int, text: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        if doc not in self.sets:
            s = shingles(text)
            if self.held + len(s) > self.most:
                self.sets.clear()
                self.held = 0
            self.sets[doc] = (s, [np.sort(prefix(s, self.heavy, seed)) for seed in ORDERS])
            self.held += 2 * len(s)
        return self.sets[doc]


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def verify(pairs: DataFrame, docs: DataFrame, heavy) -> DataFrame:
    """Those of the pairs (a, b) that link, written.  ``docs`` has a class's text under its doc_id."""
    schema = arrow_schema("a long, b long")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    docs = docs.join(small(materialize(ids, "involved")), "doc_id", "left_semi")
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # the side that repeats, a list's first member, joins last: its text then follows each pair once
    with_text = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(heavy.value)
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            texts = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *texts, strict=True):
                (x, px), (y, py) = sets.get(a, ta), sets.get(b, tb)
                if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                    continue
                if all(common(p, q) for p, q in zip(px, py, strict=True)) and linked(common(x, y), len(x), len(y)):
                    out["a"].append(a)
                    out["b"].append(b)
            yield record_batch(out, schema)

    return materialize(with_text.mapInArrow(check, "a long, b long"), "links")


def block_links(members: DataFrame, docs: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between components among the members (cluster, doc_id, n), blocks of documents against blocks.

    Documents of a cluster are dealt by size, in steps in which sizes grow to 1 / 0.8, and
    then by hash to blocks of about ``BLOCK_DOCS``.  Only blocks of the same or of
    neighbouring steps can hold links, and meet.  A task gets two blocks.  Only the
    members' texts move.
    """
    step = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    sized = members.withColumn("step", step)
    parts = sized.groupBy("cluster", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"))
    parts = materialize(parts, "block_parts")
    block = F.struct("step", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    numbered = materialize(sized.join(parts, ["cluster", "step"]).select("cluster", "doc_id", "n", block.alias("block")), "members")
    every = parts.select("cluster", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("cluster", F.struct("step", "part").alias("block"))
    near = every.select("cluster", F.explode(F.array(F.col("block.step"), F.col("block.step") - 1)).alias("step"), F.col("block").alias("block2"))
    meet = every.withColumn("step", F.col("block.step")).join(near, ["cluster", "step"]).where("block2 >= block").select("cluster", "block", "block2")
    meet = materialize(meet, "block_pairs")
    firsts = numbered.join(meet, ["cluster", "block"]).select("cluster", "block", "block2", "doc_id", F.lit(0).alias("side"))
    seconds = meet.where("block < block2").join(numbered.withColumnRenamed("block", "block2"), ["cluster", "block2"]).select("cluster", "block", "block2", "doc_id", F.lit(1).alias("side"))
    involved = small(materialize(numbered.select("doc_id").distinct(), "involved"))
    texts = docs.select("doc_id", "text").join(involved, "doc_id", "left_semi")
    rows = firsts.unionByName(seconds).join(texts, "doc_id").join(comp.withColumnRenamed("v", "doc_id"), "doc_id", "left")
    rows = rows.select("cluster", "block", "block2", "doc_id", "side", F.col("text").cast("binary").alias("text"), F.coalesce("root", "doc_id").alias("root"))
    schema = arrow_schema("a long, b long")

    def compare(group: pa.Table) -> pa.Table:
        ids, side = group.column("doc_id").to_pylist(), group.column("side").to_numpy()
        sets = [shingles(t) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        parent = {r: r for r in group.column("root").to_pylist()}
        root = group.column("root").to_pylist()

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        same = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order][:1] ^ np.uint64(1)) != 0)
        ends = np.append(same[1:], len(order))
        several = ends - same > 1
        dense = np.zeros((len(sets), int(several.sum())), np.float32)
        for column, (a, b) in enumerate(zip(same[several], ends[several], strict=True)):
            dense[who[order[a:b]], column] = 1
        shared = dense @ dense.T
        ok = 100 * shared >= PERCENT * (sizes[:, None] + sizes[None, :] - shared)
        out: dict[str, list] = {"a": [], "b": []}
        one_block = not side.any()
        for i, j in zip(*np.nonzero(np.triu(ok & (shared > 0), 1)), strict=True):
            if one_block or side[i] != side[j]:
                x, y = find(root[i]), find(root[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out["a"].append(min(ids[i], ids[j]))
                    out["b"].append(max(ids[i], ids[j]))
        return pa.Table.from_batches([record_batch(out, schema)])

    return materialize(rows.groupBy("cluster", "block", "block2").applyInArrow(compare, "a long, b long"), "block_links")


def headed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (token, size class, doc_id, n) whose token is not alone, each with the first row (a, na) of its token and class.

    The batches are sorted by token, class and doc_id; the last row of one waits for the next.
    """
    last, kept = [np.empty(0, np.int64)] * 6, False
    for batch in batches:
        if not batch.num_rows:
            continue
        t, size_class, doc, n = (np.concatenate([last[k], batch.column(k).to_numpy()]) for k in range(4))
        same = t[1:] == t[:-1]
        first = np.ones(len(t), bool)
        first[1:] = ~same | (size_class[1:] != size_class[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
        a, na = doc[at], n[at]
        if len(last[0]):
            a[at == 0], na[at == 0] = last[4], last[5]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= kept
        kept, keep[-1] = bool(keep[-1]), False
        last = [x[-1:] for x in (t, size_class, doc, n, a, na)]
        if keep.any():
            yield record_batch({"token": t[keep], "doc_id": doc[keep], "n": n[keep], "a": a[keep], "na": na[keep]}, schema)
    if kept:
        yield record_batch({"token": last[0], "doc_id": last[2], "n": last[3], "a": last[4], "na": last[5]}, schema)


def token_lists(reps: DataFrame, heavy) -> DataFrame:
    """Written (token, doc_id, n, a, na): prefix tokens that several classes have; two classes that link share one.

    ``a`` is the head of the row's list, its first member of the size class that the row can
    link within.  Heads come with the rows' one sort, so no list is joined with its heads.
    """
    schema = arrow_schema("token long, doc_id long, n int")
    ddl = "token long, doc_id long, n int, a long, na int"
    listed = arrow_schema(ddl)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, 4 << 20):
            sets = [shingles(t) for t in texts]
            parts = [prefix(s, heavy.value) for s in sets]
            sizes = [len(p) for p in parts]
            tokens = np.concatenate(parts).view(np.int64)
            found = record_batch({"token": tokens, "doc_id": np.repeat(np.array(ids, np.int64), sizes), "n": np.repeat([len(s) for s in sets], sizes)}, schema)
            for at in range(0, found.num_rows, 200_000):
                yield found.slice(at, 200_000)

    postings = id_text(reps).mapInArrow(post, "token long, doc_id long, n int").repartition("token")
    placed = postings.select("token", F.floor(F.log2("n") * 2).alias("class"), "doc_id", "n").sortWithinPartitions("token", "class", "doc_id")
    return materialize(placed.mapInArrow(lambda batches: headed(batches, listed), ddl), "lists")


def heavy_of(reps: DataFrame):
    """The broadcast heavy tokens of the classes' texts."""
    spark = reps.sparkSession
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sparkContext.broadcast(heavy_tokens(reps, buckets))


def links_and_components(docs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(v, root) of the classes that have links; ``reps`` has one text per class, ``sets`` what ``classes`` gives."""
    heavy = heavy_of(reps)
    lists = token_lists(reps, heavy)

    star = lists.where(f"doc_id <> a AND 100 * least(n, na) >= {PERCENT} * greatest(n, na)").select("a", F.col("doc_id").alias("b")).distinct()
    star = materialize(star, "star_pairs")
    texts = id_text(reps)
    links = verify(possible(star, sets), texts, heavy)
    comp = materialize(components(links), "components")

    # lists that hold more than one component are not settled
    placed = lists.join(comp.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("size")).where("r1 < r2").select("token", "size")
    open_lists = materialize(placed.join(mixed, "token"), "open_lists")
    short = open_lists.where(F.col("size") <= LONG)
    one = short.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    two = short.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    fits = f"a < b AND ra <> rb AND 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    pairs = one.join(two, "token").where(fits).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    links = links.unionByName(verify(possible(materialize(pairs, "pairs"), sets), texts, heavy))

    long = open_lists.where(F.col("size") > LONG)
    if long.limit(1).count():
        heads = long.groupBy("token").agg(F.min("doc_id").alias("b"))
        joined = components(long.join(heads, "token").select(F.col("doc_id").alias("a"), "b"))
        members = long.select("doc_id", "n").distinct().join(joined.select(F.col("v").alias("doc_id"), F.col("root").alias("cluster")), "doc_id")
        links = links.unionByName(block_links(members.select("cluster", "doc_id", "n"), texts, comp))
    heavy.unpersist()
    return materialize(components(links), "components")


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``classes`` gives, (doc_id, n_shingles, class_id) of all rows, and the rows with one text per class."""
    sets = classes(docs)
    key = ["n_shingles", "d1", "d2"]
    first = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("class_id"))
    known = materialize(sets.join(first, key, "left").select("doc_id", "n_shingles", "class_id"), "classes")
    others = known.where("class_id IS NULL OR class_id <> doc_id").select("doc_id").distinct()
    # a doc_id may stand for one class and be a copy in another: it then takes part with each text
    others = small(materialize(others.join(known.where("class_id = doc_id").select("doc_id"), "doc_id", "left_anti"), "copies"))
    # every later pass reads these texts, so they are joined once and written
    return sets, known, materialize(id_text(docs).where("doc_id IS NOT NULL").join(others, "doc_id", "left_anti"), "representatives")


def class_links(docs: DataFrame) -> DataFrame:
    """Every link (a, b), a < b, between first documents of distinct classes, written.

    All pairs that share a prefix token are verified, also inside a component; so the
    result and the work grow with the square of a group of near copies.  ``class_id``
    of ``near_duplicates`` tells which documents a class has.
    """
    sets, _, reps = classified(docs)
    heavy = heavy_of(reps)
    lists = token_lists(reps, heavy)
    one = lists.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"))
    two = lists.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = one.join(two, "token").where(f"a < b AND 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b").distinct()
    links = materialize(verify(possible(materialize(pairs, "pairs"), sets), id_text(reps), heavy).distinct(), "class_links")
    heavy.unpersist()
    return links


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text), where each of several texts of one doc_id has an id of its own, and a table (doc_id, real, h) of those and the text's hash.

    The table is None if no doc_id has several texts.
    """
    rows = id_text(docs)
    # nulls and empty texts are alike: sets without shingles
    seen = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h1"), F.max(F.xxhash64("text")).alias("h2"))
    several = materialize(seen.where("h1 <> h2").select("doc_id"), "several_texts")
    if not several.limit(1).count():
        return rows, None
    marked = rows.join(small(several.withColumn("several", F.lit(True))), "doc_id", "left")
    for salt in range(100):
        own = F.xxhash64(F.lit(salt), "doc_id", "text")
        apart = marked.select(F.when(F.col("several"), own).otherwise(F.col("doc_id")).alias("id"), "doc_id", "text", "several")
        names = materialize(apart.where("several").select("id", "doc_id", F.xxhash64("text").alias("h")).distinct(), "names")
        # an id must neither stand for two texts nor be another document's
        texts = names.count() < apart.where("several").select("doc_id", "text").distinct().count()
        if not texts and not names.select("id").join(seen.select(F.col("doc_id").alias("id")), "id", "left_semi").limit(1).count():
            return apart.select(F.col("id").alias("doc_id"), "text"), names.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("real"), "h")
    raise RuntimeError("no salt keeps the ids apart")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id (the first document with an equal set)."""
    rows, names = told_apart(docs)
    if names is None:
        return linked_rows(rows)
    found = materialize(linked_rows(rows).join(names.drop("h"), "doc_id", "left").withColumn("real", F.coalesce("real", "doc_id")), "told_apart")
    # texts of one doc_id join their components; the smallest doc_id names what comes out
    head = found.where("real IS NOT NULL").groupBy("real").agg(F.min("component_id").alias("a"))
    edges = found.join(head, "real").select("a", F.col("component_id").alias("b")).distinct()
    joined = components(edges).select(F.col("v").alias("component_id"), "root")
    placed = materialize(found.join(joined, "component_id", "left").withColumn("root", F.coalesce("root", "component_id")), "placed")
    first = placed.groupBy("root").agg(F.min("real").alias("first"))
    alike = placed.groupBy("class_id").agg(F.min("real").alias("first_alike"))
    named = placed.join(first, placed["root"].eqNullSafe(first["root"]), "left").drop(first["root"])
    named = named.join(alike, named["class_id"].eqNullSafe(alike["class_id"]), "left")
    return named.select(F.col("real").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"), F.col("first_alike").alias("class_id"))


def linked_rows(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` gives, where each doc_id has one text."""
    sets, known, reps = classified(docs)
    root = links_and_components(docs, reps, sets)
    there = F.col("doc_id").isNotNull()
    return known.join(root.withColumnRenamed("v", "class_id"), "class_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(there, F.coalesce("root", "class_id", "doc_id")).alias("component_id"),
        F.when(there, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is first of its group; rows with empty sets or a null doc_id all stay.

    Where a doc_id has several texts, each stays or goes for itself.
    """
    rows, names = told_apart(docs)
    copies = linked_rows(rows).where("component_id <> doc_id").select("doc_id").distinct()
    if names is None:
        copies = small(materialize(copies, "later_copies"))
        return docs.join(copies, docs["doc_id"].cast("long") == copies["doc_id"], "left_anti")
    copies = copies.join(names, "doc_id", "left").select(F.coalesce("real", "doc_id").alias("doc_id"), "h")
    copies = materialize(copies, "later_copies")
    this = F.xxhash64(docs["text"].cast("string"))
    return docs.join(copies, (docs["doc_id"].cast("long") == copies["doc_id"]) & (copies["h"].isNull() | (copies["h"] == this)), "left_anti")
