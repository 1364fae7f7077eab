"""Repair of the structure of conversations by cheapest edits, solved once for each signature.

A conversation is sound when its roles read ``(s?(ua)+)?``: an optional system
row, then user and assistant in turn.  Each row gets one character, for its role
and fault: ``s u a o`` for a sound row (``o``: any other role), the capital for a
truncated one, ``d`` for a blank or duplicate row, which has to go.  Equal strings
have equal answers, whatever the texts, so each distinct one is solved once:

1. rows of one conversation, turn, role and text are merged into one row with a
   count, before anything is shuffled by conversation; rows whose role and text
   come at an earlier turn are found by the least turn of each such pair, again
   an aggregate with partial sums;
2. rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any
   length spreads over tasks, and each task cuts its stretches into segments
   of at most ``SEGMENT`` rows;
3. the distinct strings are solved by recursion on their halves: a string's answer
   is a table of the cheapest edits from each state to each state, and the table of
   two neighbours follows from theirs;
4. answers join the segments.  A conversation in one segment is edited at once; for
   one cut by a range, the tables of its segments are combined in order first, and
   the edited pieces are hashed one after another.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of an empty
user or assistant row (5); a truncated row that stays costs 5 more.  Among cheapest
edits, the least string of initials is taken.

Rows of one turn are ordered by role, then text, nulls first everywhere; a null role
or text is one space.  Rows with a null conv_id are one conversation.  An empty table
gives no rows.  Other columns are ignored.  What one task holds of a long conversation
is the segments' answers, 16 strings of about a byte a row, and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import arrow_schema, record_batch, small
from pneumaspark.session import materialize

SEGMENT = 256
#: Salts by which segments of a common signature are dealt when answers are too many to broadcast.
SALTS = 16
DROPS, EMPTIES, UNSTOPS, REPEATS, TURNS_USER, FATES = 0, 1, 2, 3, 4, 20
RULE_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
SPACE = r"\x20\x09-\x0D"

#: States of a sound conversation: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FACTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, first_role string, last_role string"
SEGMENTS = f"conv_id long, part int, seg int, whole boolean, signature string, roles array<string>, texts array<string>, {FACTS}"


# ---- answers: {(from state, to state): (cost, audit)}

Answer = dict[tuple[int, int], tuple[int, str]]


def combine(a: Answer, b: Answer) -> Answer:
    """The cheapest edits of two neighbours; of equal cost, the least string.

    Taking the least of each part is enough: a string fixes the states it passes, so
    of two equally cheap strings between the same states neither begins with the other.
    """
    out: Answer = {}
    for (p, q), (cost, audit) in a.items():
        for r in range(4):
            if (q, r) in b:
                more, rest = b[q, r]
                found = (cost + more, audit + rest)
                if (p, r) not in out or found < out[p, r]:
                    out[p, r] = found
    return out


def _inserts() -> Answer:
    """Inserts alone: none, one or two; more would only go round."""
    none = {(p, p): (0, "") for p in range(4)}
    one = none | {(p, q): (RULE_COST["I"], "I") for (p, role), q in STEP.items() if role in NAMES}
    return combine(one, one)


INSERTS = _inserts()


def row_answer(char: str) -> Answer:
    """What can be done with one row."""
    out: Answer = {(p, p): (RULE_COST["D"], "D") for p in range(4)}
    if char == "d":
        return out
    extra = TRUNCATED_COST if char.isupper() else 0
    for (p, role), q in STEP.items():
        ways = [(RULE_COST["R"] + extra, "R")] if role in NAMES else []
        if role == char.lower():
            ways.append((RULE_COST["K"] + extra, "K"))
        if ways:
            out[p, q] = min(ways)
    return out


@lru_cache(maxsize=200_000)
def rows_answer(signature: str) -> Answer:
    """The table of a signature, inserts before each row included, from those of its halves."""
    if len(signature) == 1:
        return combine(INSERTS, row_answer(signature))
    half = 1 << (len(signature) - 1).bit_length() - 1
    return combine(rows_answer(signature[:half]), rows_answer(signature[half:]))


def solve(signature: str) -> Answer:
    """The table of a signature with inserts before, between and after its rows."""
    return combine(rows_answer(signature), INSERTS) if signature else INSERTS


def best(answer: Answer) -> tuple[int, int, str]:
    """(cost, last state, audit) of the cheapest edits from the start to a sound end."""
    cost, audit, end = min((*answer[START, q], q) for q in ENDS if (START, q) in answer)
    return cost, end, audit


def next_role(state: int) -> str:
    return "a" if state == USER else "u"


def replay(signature: str, roles: list[str], texts: list[str], audit: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits; ``roles`` and ``texts`` are those of rows that aren't ``d``."""
    out, row, kept = [], 0, 0
    for edit in audit:
        role, text = NAMES[next_role(state)], ""
        if edit != "I":
            if signature[row] != "d":
                if edit == "K":
                    role = roles[kept]
                text = texts[kept]
                kept += 1
            row += 1
        if edit != "D":
            state = STEP[state, role[0]]
            out.append((role, text))
    return out


def pieces_of(signatures: list[str], audit: str) -> list[tuple[int, str]]:
    """(state before, edits) of each segment of a conversation; inserts go with the row that follows them, the last ones with the last."""
    out, state, at = [], START, 0
    for k, signature in enumerate(signatures):
        begin, before, row = at, state, 0
        while at < len(audit) and (row < len(signature) or k == len(signatures) - 1):
            edit = audit[at]
            if edit == "K":
                state = STEP[state, signature[row].lower()]
            elif edit in "RI":
                state = STEP[state, next_role(state)]
            row += edit != "I"
            at += 1
        out.append((before, audit[begin:at]))
    return out


# ---- damage: what the pinned query does to its table first


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _own(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), *more)


def plain_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): equal rows of a turn as one, nulls of role and text as a space."""
    return _own(rows).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))


def damaged_rows(rows: DataFrame) -> DataFrame:
    """Rows as ``plain_rows`` gives them, after faults that depend on conv_id and turn; a dropped row stays with 0 copies and no text."""
    fate = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % FATES
    own = _own(rows, fate.alias("fate"))
    text = F.when(F.col("fate").isin(DROPS, EMPTIES), "").when(F.col("fate") == UNSTOPS, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == DROPS, "").when(F.col("fate") == TURNS_USER, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == DROPS, 0).when(F.col("fate") == REPEATS, 2).otherwise(1)
    after = own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return after.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


# ---- rows to segments


def mark_earlier(rows: DataFrame) -> DataFrame:
    """Adds ``earlier``: the conversation has the row's role and text at an earlier turn.

    Only pairs at several turns are looked up: they are few as a rule and then broadcast.
    Beyond that the join shuffles, and Spark splits what is skewed in it.
    """
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    digest = F.sha2(F.concat_ws(":", F.sha2("role", 256), "text"), 256)
    keyed = rows.where("copies > 0").select("conv_id", digest.alias("digest"), turn.alias("turn"))
    first = keyed.groupBy("conv_id", "digest").agg(F.min("turn").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    first = small(materialize(first, "repeated_texts"))
    found = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (digest == F.col("_digest")), "left")
    return found.select(*rows.columns, F.coalesce(turn > F.col("_first"), F.lit(False)).alias("earlier"))


class Stretch:
    """The rows of one conversation in one task, as they go into the open segment."""

    SOUND = {"su", "ua", "au"}
    BLANKS = " \t\n\x0b\x0c\r"

    def __init__(self, conv_id: int | None, seg: int = 0):
        self.conv_id, self.seg = conv_id, seg
        self.chars: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.held = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        initial, stripped = role[:1], text.rstrip(self.BLANKS)
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.first_role is None:
            self.first_role = initial
        elif self.last_role + initial not in self.SOUND:
            self.illegal += 1
        self.last_role = initial
        if not stripped or again:
            self.blank += not stripped
            self.duplicate += bool(stripped)
            self.chars.append("d")
            return
        char = initial if initial in ("s", "u", "a") else "o"
        if stripped[-1] not in ".!?":
            self.truncated += 1
            char = char.upper()
        self.chars.append(char)
        self.roles.append(role)
        self.texts.append(text)
        self.held += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.chars) >= most_rows or self.held >= 1 << 22

    def row(self, part: int, whole: bool) -> tuple:
        facts = (len(self.chars), self.blank, self.duplicate, self.truncated, self.illegal, self.n_turns, self.first_turn, self.last_turn, self.first_role, self.last_role)
        return (self.conv_id, part, self.seg, whole, "".join(self.chars), self.roles, self.texts, *facts)


def segments(rows: DataFrame, most_rows: int = SEGMENT) -> DataFrame:
    """Segments of conversations; ``whole`` marks a conversation that lies in one segment, away from its task's ends."""
    schema = arrow_schema(SEGMENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_, begun = TaskContext.get().partitionId(), None, 0
        done: list[tuple] = []
        held = 0
        for batch in batches:
            for conv_id, turn, role, text, copies, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.row(part, whole=begun > 1 and open_.seg == 0))
                    open_, begun = Stretch(conv_id), begun + 1
                for k in range(copies):
                    if open_.full(most_rows):
                        done.append(open_.row(part, whole=False))
                        open_ = Stretch(conv_id, open_.seg + 1)
                    open_.add(turn, role, text, earlier or k > 0)
                held += len(text)
                if len(done) >= 1000 or held >= 1 << 23:
                    if done:
                        yield _batch(done, schema)
                    done, held = [], 0
        if open_ is not None:
            done.append(open_.row(part, whole=False))
            yield _batch(done, schema)

    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = mark_earlier(rows).select("conv_id", "turn", "role", "text", "copies", "earlier").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, SEGMENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)


# ---- distinct signatures, and their answers back to the segments

ANSWERS = "signature string, cost long, audit string, answer array<struct<p:int,q:int,cost:long,audit:string>>"


def answers(cut: DataFrame) -> DataFrame:
    """(signature, cost, audit, answer) of each distinct signature; cost and audit are those of a whole conversation."""
    schema = arrow_schema(ANSWERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for signature in batch.column(0).to_pylist():
                answer = solve(signature)
                cost, _, audit = best(answer)
                rows.append((signature, cost, audit, [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in answer.items()]))
            if rows:
                yield _batch(rows, schema)

    return cut.select("signature").distinct().mapInArrow(run, ANSWERS)


def with_answers(cut: DataFrame, solved: DataFrame) -> DataFrame:
    """Segments with their answers: broadcast if they are few, else joined under salts, as a common signature may hold most segments."""
    near = small(solved)
    if near is not solved:
        return cut.join(near, "signature")
    salted = solved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cut.withColumn("_salt", F.pmod(F.hash("conv_id", "part", "seg"), F.lit(SALTS))).join(salted, ["signature", "_salt"]).drop("_salt")


# ---- conversations that a range cuts: their segments' tables in order

VERDICTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part:int,seg:int,state:int,edits:string>>"


def _tree(tables: list[Answer]) -> Answer:
    while len(tables) > 1:
        tables = [combine(*pair) if len(pair) == 2 else pair[0] for pair in (tables[k : k + 2] for k in range(0, len(tables), 2))]
    return tables[0]


def _by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Groups of consecutive rows of one conv_id, the first column."""
    return groupby((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=itemgetter(0))


def _facts(parts: list[dict]) -> tuple[int, int, int, int, int]:
    """(gaps, blank, duplicate, truncated, illegal) of segments in order; empty ones, of dropped rows, say nothing."""
    parts = [p for p in parts if p["n_rows"]]
    illegal, n_turns, first, last, role = 0, 0, None, None, None
    for p in parts:
        illegal += p["illegal"] + (role is not None and role + p["first_role"] not in Stretch.SOUND)
        n_turns += p["n_turns"] - (last is not None and last == p["first_turn"])
        first = p["first_turn"] if first is None else first
        last, role = p["last_turn"] if p["last_turn"] is not None else last, p["last_role"]
    gaps = 0 if first is None else last - first + 1 - n_turns
    return gaps, sum(p["blank"] for p in parts), sum(p["duplicate"] for p in parts), sum(p["truncated"] for p in parts), illegal


def verdicts(solved: DataFrame) -> DataFrame:
    """One row for each conversation of several segments: its facts, its edits, and each segment's share of them."""
    schema = arrow_schema(VERDICTS)
    names = ["conv_id", "part", "seg", "signature", *[f.split()[0] for f in FACTS.split(", ")], "answer"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in _by_conversation(batches):
            parts = [dict(zip(names, row, strict=True)) for row in group]
            cost, _, audit = best(_tree([{(a["p"], a["q"]): (a["cost"], a["audit"]) for a in p["answer"]} for p in parts]))
            pieces = [{"part": p["part"], "seg": p["seg"], "state": state, "edits": edits} for p, (state, edits) in zip(parts, pieces_of([p["signature"] for p in parts], audit), strict=True)]
            yield _batch([(conv_id, *_facts(parts), cost, audit, pieces)], schema)

    return solved.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(run, VERDICTS)


def edited(rows: DataFrame, most_rows: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole conversations with their edits, segments of the others with theirs, and the others' verdicts, from ``plain_rows`` or ``damaged_rows``."""
    cut = materialize(segments(rows, most_rows), "segments")
    solved = with_answers(cut, materialize(answers(cut), "answers"))
    whole = solved.where("whole").withColumn("state", F.lit(START)).withColumnRenamed("audit", "edits").drop("answer")
    others = materialize(verdicts(solved.where("not whole")), "verdicts")
    shares = others.select(F.col("conv_id").alias("_conv"), F.explode("pieces").alias("_p")).select("_conv", F.col("_p.part").alias("_part"), F.col("_p.seg").alias("_seg"), F.col("_p.state").alias("state"), F.col("_p.edits").alias("edits"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("seg") == F.col("_seg"))
    return whole, cut.where("not whole").join(shares, same).drop("_conv", "_part", "_seg"), others


def repaired_rows(rows: DataFrame, most_rows: int = SEGMENT) -> DataFrame:
    """The conversations after repair: (conv_id, part, seg, nth, role, text), in order of part, seg and nth within each."""
    ddl = "conv_id long, part int, seg int, nth int, role string, text string"
    schema = arrow_schema(ddl)
    columns = ["conv_id", "part", "seg", "signature", "roles", "texts", "edits", "state"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, part, seg, signature, roles, texts, edits, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = replay(signature, roles, texts, edits, state)
                if out:
                    yield _batch([(conv_id, part, seg, k, role, text) for k, (role, text) in enumerate(out)], schema)

    whole, others, _ = edited(rows, most_rows)
    return whole.select(*columns).unionByName(others.select(*columns)).mapInArrow(run, ddl)


def repair_report(rows: DataFrame, most_rows: int = SEGMENT) -> DataFrame:
    """One row for each conversation: its gaps and faults, the cost and initials of its cheapest edits, and a digest of the repaired text."""
    schema = arrow_schema(REPORT)
    names = [f.split()[0] for f in FACTS.split(", ")]

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for conv_id, signature, roles, texts, cost, edits, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = "\n".join(f"{role}:{text}" for role, text in replay(signature, roles, texts, edits))
                done.append((conv_id, *_facts([dict(zip(names, facts, strict=True))]), cost, edits, hashlib.sha256(lines.encode()).hexdigest()))
            if done:
                yield _batch(done, schema)

    pieces = "conv_id long, part int, seg int, lines string"
    piece_schema, hashed = arrow_schema(pieces), arrow_schema("_conv long, repaired_sha256 string")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                (conv_id, part, seg, "\n".join(f"{role}:{text}" for role, text in replay(signature, roles, texts, edits, state)))
                for conv_id, part, seg, signature, roles, texts, edits, state in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            if done:
                yield _batch(done, piece_schema)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in _by_conversation(batches):
            sha, empty = hashlib.sha256(), True
            for *_, lines in group:
                if lines:
                    sha.update(lines.encode() if empty else b"\n" + lines.encode())
                    empty = False
            yield _batch([(conv_id, sha.hexdigest())], hashed)

    whole, others, found = edited(rows, most_rows)
    at_once = whole.select("conv_id", "signature", "roles", "texts", "cost", "edits", *names).mapInArrow(finish, REPORT)
    parts = others.select("conv_id", "part", "seg", "signature", "roles", "texts", "edits", "state").mapInArrow(joined, pieces)
    digests = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(digest, "_conv long, repaired_sha256 string")
    cut = found.drop("pieces").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return at_once.unionByName(cut)
