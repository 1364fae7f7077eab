"""License scanning: winnowed template fingerprints, then banded alignment.

Templates are cut to words; of every run of three word ids one fingerprint is
kept in each window of ``WINNOW`` neighbours (the smallest hash), and an inverted
index maps a fingerprint to its places in the templates.  A document's own
three-word hashes are looked up in that index; each hit names a template and a
diagonal, and neighbouring diagonals make a candidate.  A banded Smith-Waterman
alignment of the words around a candidate then gives the matched words, the
coverage of the template and the span in the document.

Words are lower-case runs of letters, digits and non-ASCII bytes.  Null and empty
texts have no spans.  Repeated rows are scanned each time.  The templates are a
parameter whose size bounds the index; documents are never collected.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.llm.common import map_docs, mix64

# Public license notices, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}
K = 3
WINNOW = 2
BAND = 6
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_COVERAGE = 0.6
MIN_WORDS = 4

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATORS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SEPARATORS).split()


class Index:
    """Templates as word ids, and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.vocabulary: dict[bytes, int] = {}
        self.words: list[list[int]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(templates[name].encode())]
            self.words.append(ids)
            h = self.hashes(np.array(ids, np.uint64))
            chosen = {at + int(np.argmin(h[at : at + WINNOW])) for at in range(max(1, len(h) - WINNOW + 1))} if len(h) else set()
            for at in sorted(chosen):
                self.places[int(h[at])].append((t, at))
        self.known = np.array(sorted(self.places), np.uint64)

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        if len(ids) < K:
            return np.empty(0, np.uint64)
        h = np.zeros(len(ids) - K + 1, np.uint64)
        for j in range(K):
            h = h * np.uint64(1_000_003) + ids[j : len(ids) - K + 1 + j]
        return mix64(h)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, first diagonal) of each group of hits on neighbouring diagonals."""
        h = self.hashes(ids)
        if not len(h) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = sorted({(t, int(p) - q) for p in np.flatnonzero(self.known[at] == h) for t, q in self.places[int(h[p])]})
        out: list[tuple[int, int]] = []
        for t, d in hits:
            if not out or out[-1][0] != t or d - out[-1][1] > BAND:
                out.append((t, d))
        return out

    def align(self, ids: list[int], t: int, diagonal: int) -> tuple[int, int, int, int]:
        """(score, matched words, first word, word after the last) of the best local alignment near a diagonal."""
        template = self.words[t]
        best = (0, 0, 0, 0)
        above: dict[int, tuple[int, int, int]] = {}
        for i in range(max(0, diagonal - BAND), min(len(ids), diagonal + len(template) + 2 * BAND)):
            row: dict[int, tuple[int, int, int]] = {}
            low = max(0, i - diagonal - 2 * BAND)
            for j in range(low, min(len(template), i - diagonal + BAND + 1)):
                same = ids[i] == template[j]
                s, m, start = above.get(j - 1, (0, 0, i))
                cell = (s + (MATCH if same else MISMATCH), m + same, start if s > 0 else i)
                for s, m, start in (above.get(j, (0, 0, i)), row.get(j - 1, (0, 0, i))):
                    if s + GAP > cell[0]:
                        cell = (s + GAP, m, start)
                if cell[0] > 0:
                    row[j] = cell
                    if cell[0] > best[0]:
                        best = (cell[0], cell[1], cell[2], i + 1)
            above = row
        return best

    def accepted(self, ids: np.ndarray, t: int, diagonal: int, kept: list[tuple]) -> list[tuple]:
        """The best alignment near a diagonal in each stretch that accepted spans leave free, if it covers enough."""
        low, high = max(0, diagonal - 2 * BAND), min(len(ids), diagonal + len(self.words[t]) + 3 * BAND)
        taken = sorted((max(a, low), min(b, high)) for _, a, b, *_ in kept if a < high and b > low)
        out = []
        for a, b in zip([low, *(b for _, b in taken)], [*(a for a, _ in taken), high]):
            if b - a >= MIN_WORDS:
                score, matched, first, end = self.align(ids[a:b].astype(int).tolist(), t, diagonal - a)
                coverage = matched / len(self.words[t])
                if matched >= MIN_WORDS and coverage >= MIN_COVERAGE:
                    out.append((-score, first + a, end + a, t, matched, coverage))
        return out

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start byte, end byte); of overlapping spans the best score stays.

        What lies around the accepted spans is aligned again, until nothing more is accepted.
        """
        split = words_of(text) if text else []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in split), np.uint64, len(split))
        kept: list[tuple] = []
        open_ones = set(self.candidates(ids))
        while open_ones:
            found = []
            for t, d in sorted(open_ones):
                hits = self.accepted(ids, t, d, kept)
                found += hits
                if not hits:
                    open_ones.discard((t, d))
            before = len(kept)
            for hit in sorted(found):
                if all(hit[2] <= k[1] or hit[1] >= k[2] for k in kept):
                    kept.append(hit)
            if len(kept) == before:
                break
        if not kept:
            return []
        spans = [m.span() for m in _WORD.finditer(text.lower())]
        return [(self.names[t], coverage, matched, spans[first][0], spans[end - 1][1]) for _, first, end, t, matched, coverage in sorted(kept, key=lambda k: k[1])]


_indexes: dict[tuple, Index] = {}

SPANS = "license_id string, coverage double, matched_words long, span_start long, span_end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, licenses array of (license_id, coverage, matched_words, span_start, span_end).

    Spans are code points of the text, end exclusive, and don't overlap.
    """
    key = tuple(sorted((templates or TEMPLATES).items()))
    names = [c.split()[0] for c in SPANS.split(", ")]

    def scan(ids: list, texts: list) -> dict:
        if key not in _indexes:
            _indexes[key] = Index(dict(key))
        index, out = _indexes[key], []
        for t in texts:
            at = (lambda b, t=t: len(t[:b].decode("utf-8", "replace")))
            out.append([dict(zip(names, (name, c, m, at(a), at(b)), strict=True)) for name, c, m, a, b in index.scan(t)])
        return {"doc_id": ids, "n_words": [len(words_of(t)) if t else 0 for t in texts], "licenses": out}

    inner = ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in SPANS.split(", "))
    return map_docs(docs, scan, f"doc_id long, n_words long, licenses array<struct<{inner}>>")


def license_report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_licenses, license_ids, best_coverage, spans ``id:start:end``."""
    licenses = F.col("licenses")
    return scan_licenses(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(licenses).cast("long").alias("n_licenses"),
        F.concat_ws(",", F.transform(licenses, lambda x: x["license_id"])).alias("license_ids"),
        F.coalesce(F.array_max(F.transform(licenses, lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.concat_ws(",", F.transform(licenses, lambda x: F.concat_ws(":", x["license_id"], x["span_start"], x["span_end"]))).alias("spans"),
    )
