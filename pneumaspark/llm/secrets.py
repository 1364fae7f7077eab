"""Secret scanning with deterministic automata compiled from the rules.

Each rule has a trigger, a regular expression over bytes that every match of the
rule contains; it is kept short, since counters of several rules multiply the states.
All triggers together become one nondeterministic automaton,
made deterministic by subset construction over byte classes and minimised by
partition refinement; its states are arrays of next states.  One pass over a
text's UTF-8 bytes tells which rules can match.  For those, the rule's own automaton,
compiled alike from the whole expression but bound to its start, is walked from
where a match can begin to its last accepting byte; that gives the spans, whose
ends are then counted in code points.

Spans of a kind are leftmost and don't overlap; kinds may overlap each other.
Null and empty texts have no spans.  Repeated rows are scanned each time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from pneumaspark.llm.common import map_docs

_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def _either_case(pattern: str) -> str:
    return re.sub(r"(?<![\\a-zA-Z0-9])[a-z]+|(?<=[|_?])[a-z]+", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), pattern)


_NAME = _either_case(_ASSIGN)
#: kind, trigger for the combined automaton, whole expression, what comes before the part that counts, least bytes of that part.
RULES: list[tuple[str, str, str, str | None, int]] = [
    ("assign", _NAME + _VALUE + "{6}", _NAME + _VALUE + "+", _NAME, 6),
    ("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", None, 20),
    ("hex", "[0-9a-f]{24}", "[0-9a-f]+", None, 24),
    ("private_key", "-----BEGIN ", "-----BEGIN [A-Z ]*PRIVATE KEY-----", None, 0),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]{36,}", None, 0),
    ("chat_token", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]{10,}", None, 0),
    ("web_token", "eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None, 0),
]
BASE = ("assign", "access", "hex")


class _Nfa:
    """A Thompson automaton over bytes; ``edges[s]`` holds (bytes, target), ``free[s]`` empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """(first, last) state of a pattern of literals, classes, groups, ``|``, ``? * + {n} {m,n}`` and escapes."""
        pos = 0

        def escape() -> int:
            nonlocal pos
            c = pattern[pos]
            pos += 1
            if c == "x":
                pos += 2
                return int(pattern[pos - 2 : pos], 16)
            return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

        def byte() -> int:
            nonlocal pos
            c = pattern[pos]
            pos += 1
            return escape() if c == "\\" else ord(c)

        def char_class() -> frozenset:
            nonlocal pos
            negated = pattern[pos] == "^"
            pos += negated
            found: set[int] = set()
            while pattern[pos] != "]":
                low = byte()
                if pattern[pos] == "-" and pattern[pos + 1] != "]":
                    pos += 1
                    found.update(range(low, byte() + 1))
                else:
                    found.add(low)
            pos += 1
            return frozenset(range(256)) - found if negated else frozenset(found)

        def atom(at: int) -> tuple[int, int]:
            """Build the atom at ``at``; leaves ``pos`` behind it."""
            nonlocal pos
            pos = at
            c = pattern[pos]
            pos += 1
            if c == "(":
                both = choice()
                pos += 1
                return both
            if c == "[":
                chars = char_class()
            elif c == "\\":
                chars = frozenset([escape()])
            else:
                chars = frozenset(range(256)) - {10} if c == "." else frozenset([ord(c)])
            first, last = self.state(), self.state()
            self.edges[first].append((chars, last))
            return first, last

        def repeated() -> tuple[int, int]:
            nonlocal pos
            start = pos
            first, last = atom(start)
            low, high = 1, 1
            end = pos
            if end < len(pattern) and pattern[end] in "?*+{":
                if pattern[end] == "{":
                    close = pattern.index("}", end)
                    least, comma, most = pattern[end + 1 : close].partition(",")
                    low, high = int(least), int(most) if most else None if comma else int(least)
                    end = close + 1
                else:
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[end]]
                    end += 1
            parts = [(first, last)]
            for _ in range(1, max(low, high or 1)):
                parts.append(atom(start))
            pos = end
            for (_, a), (b, _) in zip(parts, parts[1:]):
                self.free[a].append(b)
            out = self.state()
            self.free[parts[-1][1]].append(out)
            for k in range(low, high if high is not None else low + 1):
                if k < len(parts):
                    self.free[parts[k][0]].append(out)
            if high is None:
                self.free[parts[-1][1]].append(parts[-1][0])
            return parts[0][0], out

        def sequence() -> tuple[int, int]:
            first = last = self.state()
            while pos < len(pattern) and pattern[pos] not in "|)":
                a, b = repeated()
                self.free[last].append(a)
                last = b
            return first, last

        def choice() -> tuple[int, int]:
            nonlocal pos
            first, last = self.state(), self.state()
            while True:
                a, b = sequence()
                self.free[first].append(a)
                self.free[b].append(last)
                if pos >= len(pattern) or pattern[pos] != "|":
                    return first, last
                pos += 1

        return choice()


def compile_dfa(patterns: list[str], anywhere: bool = True) -> tuple[list[list[int]], list[int], list[int]]:
    """(next state by state and byte class, accepted rules as bits by state, class by byte).

    State 0 starts.  A state's bits are those of the patterns that end there.  The
    automaton looks for the patterns anywhere, or only where it starts.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, p in enumerate(patterns):
        first, last = nfa.add(p)
        nfa.free[root].append(first)
        ends[last] = 1 << k
    alike: dict[tuple, int] = {}
    every = list(dict.fromkeys(chars for es in nfa.edges for chars, _ in es))
    classes = [alike.setdefault(tuple(b in chars for chars in every), len(alike)) for b in range(256)]
    sample = [classes.index(c) for c in range(len(alike))]

    def closed(states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edges[s] or s in ends)

    begin = closed([root])
    again = begin if anywhere else frozenset()
    number, order, moves = {begin: 0}, [begin], []
    for subset in order:
        row = []
        for b in sample:
            target = closed([t for s in subset for chars, t in nfa.edges[s] if b in chars]) | again
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        moves.append(row)
    accept = [sum({ends[s] for s in subset if s in ends}) for subset in order]

    block = list(accept)  # partition refinement: states stay together while their moves do
    count = 0
    while True:
        key: dict[tuple, int] = {}
        block = [key.setdefault((block[s], *[block[t] for t in moves[s]]), len(key)) for s in range(len(order))]
        if len(key) == count:
            break
        count = len(key)
    least_moves: list[list[int]] = [[] for _ in range(count)]
    least_accept = [0] * count
    for s, g in enumerate(block):
        least_moves[g] = [block[t] for t in moves[s]]
        least_accept[g] = accept[s]
    return least_moves, least_accept, classes


class Scanner:
    """The automaton as linked arrays: ``row[byte]`` is the next state's array, ``row[256]`` its rules."""

    _made: "Scanner | None" = None

    def __init__(self, patterns: list[str]):
        moves, accept, classes = compile_dfa(patterns)
        self.n_states = len(moves)
        rows: list[list] = [[] for _ in moves]
        for row, m, bits in zip(rows, moves, accept, strict=True):
            row.extend(rows[m[c]] for c in classes)
            row.append(bits)
        self.start = rows[0]

    @classmethod
    def of(cls) -> "Scanner":
        if cls._made is None:
            cls._made = cls([r[1] for r in RULES])
        return cls._made

    def rules_in(self, data: bytes) -> int:
        """Bits of the rules whose trigger occurs in ``data``."""
        row, found = self.start, 0
        for b in data:
            row = row[b]
            if row[256]:
                found |= row[256]
        return found


class Walker:
    """One expression's automaton from a start; a row is None where nothing can follow."""

    _made: "list[tuple[Walker, Walker | None, int]] | None" = None

    def __init__(self, pattern: str):
        moves, accept, classes = compile_dfa([pattern], anywhere=False)
        dead = {s for s, m in enumerate(moves) if not accept[s] and set(m) == {s}}
        rows: list[list] = [[] for _ in moves]
        for row, m, bits in zip(rows, moves, accept, strict=True):
            row.extend(None if m[c] in dead else rows[m[c]] for c in classes)
            row.append(bits)
        self.start = rows[0]

    @classmethod
    def of_rules(cls) -> "list[tuple[Walker, Walker | None, int]]":
        if cls._made is None:
            cls._made = [(cls(whole), cls(before) if before else None, least) for _, _, whole, before, least in RULES]
        return cls._made

    def end(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        row, found = self.start, -1
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is None:
                break
            if row[256]:
                found = i + 1
        return found

    def matches(self, data: bytes):
        """(start, end) of leftmost matches that don't overlap."""
        at, first = 0, self.start
        while at < len(data):
            if first[data[at]] is None:
                at += 1
                continue
            end = self.end(data, at)
            if end > at:
                yield at, end
                at = end
            else:
                at += 1


def find_secrets(text: bytes | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span in code points, in order."""
    flags = Scanner.of().rules_in(text) if text else 0
    if not flags:
        return []
    found = []
    for k, (walker, before, least) in enumerate(Walker.of_rules()):
        if flags >> k & 1:
            for a, b in walker.matches(text):
                if b - (before.end(text, a) if before else a) >= least:
                    found.append((a, k, b))
    if text.isascii():
        return sorted(found)
    # code points before a byte: bytes that don't go on from the one before
    point = dict.fromkeys(x for a, _, b in found for x in (a, b))
    last = count = 0
    for x in sorted(point):
        count += len(text[last:x].decode("utf-8", "replace"))
        point[x], last = count, x
    return sorted((point[a], k, point[b]) for a, k, b in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, spans array<struct<kind, start, end>> in code points, end exclusive."""

    def scan(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "spans": [[{"kind": RULES[k][0], "start": a, "end": b} for a, k, b in find_secrets(t)] for t in texts]}

    return map_docs(docs, scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """(doc_id, text) with every span replaced; overlapping spans become one mask; null stays null."""

    def clean(text: bytes | None) -> str | None:
        if text is None:
            return None
        plain, out, at = text.decode("utf-8", "replace"), [], 0
        for start, _, end in find_secrets(text):
            if start >= at:
                out += [plain[at:start], mask]
            at = max(at, end)
        return "".join([*out, plain[at:]])

    return map_docs(docs, lambda ids, texts: {"doc_id": ids, "text": [clean(t) for t in texts]}, "doc_id long, text string")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, made from the spans of ``find_secrets``."""

    def digest(ids: list, texts: list) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in texts:
            found = [(RULES[k][0], f"{RULES[k][0]}:{a}:{b}") for a, k, b in find_secrets(t)]
            kinds = [kind for kind, _ in found]
            for kind in BASE:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(",".join(s for kind, s in found if kind in BASE).encode()).hexdigest())
            out["spans"].append(",".join(s for _, s in found))
        return {"doc_id": ids, **out}

    return map_docs(docs, digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
