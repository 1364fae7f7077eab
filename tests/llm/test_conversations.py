"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import os
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pneumaspark.llm import catalog, conversations

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        elif fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif fate == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (row, roles so far as the pattern sees them): (cost, audit, lines)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c in follow.replace("s", ""):
            name = {"u": "user", "a": "assistant"}[c]
            heapq.heappush(heap, (cost + 5, audit + "I", i, c, (*lines, f"{name}:")))
            if i < len(rows) and not rows[i][3]:
                role, text, late, _ = rows[i]
                heapq.heappush(heap, (cost + 1 + 5 * late, audit + "R", i + 1, c, (*lines, f"{name}:{text}")))
        if i < len(rows):
            role, text, late, gone = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if not gone and role[:1] and role[:1] in follow:
                heapq.heappush(heap, (cost + 5 * late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def brute(rows, every):
    by_conv = {c: [] for c in every}
    for r in rows:
        by_conv[r[0]].append(r)
    out = []
    for conv_id, rs in by_conv.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        judged, seen, n = [], set(), [0, 0, 0]
        for _, _, role, text in rs:
            cut = text.rstrip(BLANKS)
            fault = 0 if not cut else 1 if (role, text) in seen else 2 if cut[-1] not in ".!?" else None
            if fault is not None:
                n[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault == 2, fault in (0, 1)))
        turns = {r[1] for r in rs} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, lines = cheapest(judged)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(df, most_rows=conversations.SEGMENT):
    return sorted([tuple(r) for r in conversations.repair_report(conversations.damaged_rows(df), most_rows).collect()], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = report(df)
    assert got == brute(damaged(rows), {r[0] for r in rows})
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(twin.execute(catalog.oracle_sql()["op12_conversation_repair"]).fetchall(), key=str) == got


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Hello."), (1, 9, "user", "Cut of"), (1, 10, "tool", "Out."),
    (2, None, None, None), (2, None, "user", "Yes."), (2, 4, "assistant", "No?"), (2, 4, "assistant", "No?"), (2, 4, "user", "No?"),
    (3, 1, "", "Roleless."), (3, 2, "user", " \t\n "), (4, 7, "assistant", None),
    (None, 1, "user", "Lost."), (None, 2, "assistant", "Found!"),
    *[(5, k, ("user", "assistant")[k % 2 if k % 7 else 1], f"Row {k % 40}{'.' if k % 5 else ''}") for k in range(700)],
    *[(6, 3, "user", "Same.")] * 300, *[(7, k, "user", "Same.") for k in range(100)],
]


@pytest.mark.parametrize("most_rows", [1, 3, 256])
def test_odd_rows_in_segments_of_any_size(spark, most_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "conv_id long, turn long, role string, text string, seg string, cost int").repartition(5)
    assert report(df, most_rows) == brute(damaged(ODD), {r[0] for r in ODD})


def test_no_rows_and_rows_that_all_go(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert report(spark.createDataFrame([], kind)) == []
    gone = [(c, t, "user", "x.") for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = report(spark.createDataFrame(gone, kind))
    assert got and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_repaired_rows_are_sound(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    rows = sorted((str(r.conv_id), r.part, r.seg, r.nth, r.role) for r in conversations.repaired_rows(conversations.plain_rows(df), 5).collect())
    by_conv = {}
    for conv_id, *_, role in rows:
        by_conv[conv_id] = by_conv.get(conv_id, "") + role[0]
    import re

    assert by_conv and all(re.fullmatch("(s?(ua)+)?", roles) for roles in by_conv.values())


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOd", max_size=9), st.integers(0, 9))
def test_halves_give_the_cheapest_edits(signature, at):
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "d": "user"}
    rows = [(names[c.lower()], "t", c.isupper(), c == "d") for c in signature]
    cost, audit, lines = cheapest(rows)
    found, _, edits = conversations.best(conversations.combine(conversations.solve(signature[:at]), conversations.solve(signature[at:])))
    assert (found, edits) == (cost, audit)
    kept = [r for r in rows if not r[3]]
    parts = [signature[:at], signature[at:]]
    out = []
    for part, (state, edits) in zip(parts, conversations.pieces_of(parts, audit)):
        n = sum(c != "d" for c in part)
        out += conversations.replay(part, [r[0] for r in kept[:n]], [r[1] for r in kept[:n]], edits, state)
        kept = kept[n:]
    assert [f"{r}:{t}" for r, t in out] == lines
