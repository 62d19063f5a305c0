"""Operator 8: license scans by patience alignment.

A text and a template are anchored on the words that each of them holds once; the
longest increasing run of anchors is kept, and the gaps between are aligned the
same way again, small gaps without an anchor word by word.  The share of the template's words that align is its coverage.

Only places that can reach the wanted coverage are aligned: at least that share
of a template must be found, so of any larger set of its words (its longest are
taken) one must stand in the text, and alignment happens round each of those.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

COVERAGE = 0.8
#: Stretches of words times words without an anchor that are still aligned word by word.
GAP_CELLS = 4096
WORD = r"[^\W_]+(?:[.'\-][^\W_]+)*"

#: Public license notices, as their licences give them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _anchors(a, b, a_lo, a_hi, b_lo, b_hi):
    """Pairs of places of words that stand once in a[a_lo:a_hi] and once in b[b_lo:b_hi], rising in both."""
    once: dict = {}
    for i in range(a_lo, a_hi):
        once[a[i]] = -1 if a[i] in once else i
    there: dict = {}
    for j in range(b_lo, b_hi):
        if b[j] in once:
            there[b[j]] = -1 if b[j] in there else j
    pairs = sorted((once[w], j) for w, j in there.items() if j >= 0 and once[w] >= 0)
    tops, last, back = [], [], []  # patience piles: top of each, its pair, and each pair's predecessor
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _longest(a: list, b: list, a_lo: int, b_lo: int) -> list[tuple[int, int]]:
    """A longest common run of words, with gaps, of a small stretch without anchors."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((a_lo + i, b_lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i of a, j of b) with equal words, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo == a_hi or b_lo == b_hi:
            continue
        x, y = a_lo, b_lo
        found = _anchors(a, b, a_lo, a_hi, b_lo, b_hi)
        if not found and (a_hi - a_lo) * (b_hi - b_lo) <= GAP_CELLS:
            out += _longest(a[a_lo:a_hi], b[b_lo:b_hi], a_lo, b_lo)
            continue
        out += found
        for i, j in [*found, (a_hi, b_hi)] if found else []:
            if x < i and y < j:
                todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


def _dense(pairs: list, share: float) -> list:
    """pairs without loose ends, until they are so large a share of the text's words that they span."""
    lo, hi = 0, len(pairs)
    while hi - lo > 1 and hi - lo < share * (pairs[hi - 1][0] - pairs[lo][0] + 1):
        if pairs[lo + 1][0] - pairs[lo][0] >= pairs[hi - 1][0] - pairs[hi - 2][0]:
            lo += 1
        else:
            hi -= 1
    return pairs[lo:hi]


def _tight(words: list, pairs: list) -> list:
    """The same words of the template on the nearest equal words of the text: later ones pulled to the first, then earlier ones to the last."""
    out, to = [], -1
    for i, j in pairs:
        to = next(k for k in range(to + 1 if out else i, i + 1) if words[k] == words[i])
        out.append((to, j))
    back, to = [], len(words)
    for i, j in reversed(out):
        to = next(k for k in range(to - 1 if back else i, i - 1, -1) if words[k] == words[i])
        back.append((to, j))
    return back[::-1]


def place(words: list, template: list, coverage: float) -> list:
    """The aligned pairs of a window that span a place of the template, or none that reach the coverage."""
    pairs = align(words, template)
    if len(pairs) < coverage * len(template):
        return []
    pairs = _dense(_tight(words, pairs), coverage)
    return pairs if len(pairs) >= coverage * len(template) else []


class Scanner:
    """Templates made ready for scanning whole texts."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage, self.templates = coverage, []
        for name in sorted(templates):
            words = words_of(templates[name])
            if not words:
                continue
            spare = len(words) - max(1, -(-len(words) * coverage // 1))  # words that may be missing
            order = sorted(range(len(words)), key=lambda k: (-len(words[k]), k))
            places, chosen = [], set()
            for k in order:
                if len(places) > spare:
                    break
                places.append(k)
                chosen.add(words[k])
            at: dict[str, list[int]] = {}
            for k, w in enumerate(words):
                if w in chosen:
                    at.setdefault(w, []).append(k)
            self.templates.append((name, words, at))
        self.quick = sorted({w for _, _, at in self.templates for w in at})

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, words aligned, first word, last word) of each place of a template that
        reaches the coverage in the whole text: of places that overlap, that with the most words, then the first."""
        if not text:
            return []
        low = text.lower()
        if not any(w in low for w in self.quick):
            return []
        words = re.findall(WORD, low)
        where: dict[str, list[int]] = {w: [] for w in self.quick}
        for p, w in enumerate(words):
            if w in where:
                where[w].append(p)
        out = []
        for name, template, at in self.templates:
            n, found = len(template), {}
            spots = sorted({p - k for w, ks in at.items() for p in where[w] for k in ks})
            for lo, hi in self._windows(spots, n, -int(-n * self.coverage // 1), len(words)):
                pairs = place(words[lo:hi], template, self.coverage)
                if pairs:
                    span = lo + pairs[0][0], lo + pairs[-1][0]
                    found[span] = max(found.get(span, 0), len(pairs))
            taken: list[tuple[int, int]] = []
            for first, last in sorted(found, key=lambda f: (-found[f], f)):
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    out.append((name, found[first, last] / n, found[first, last], first, last))
        return sorted(out, key=lambda h: (h[0], h[3]))

    @staticmethod
    def _windows(spots: list[int], n: int, least: int, size: int):
        """Windows round the places where a template of n words may begin: as long as it or as the least of it, wide, and
        wide but for what begins half a template later or before, so that notices in a row keep their anchors."""
        seen, slack = set(), n // 2 + 4
        for s in spots:
            after = bisect_left(spots, s + n // 2 + 1)
            end = spots[after] if after < len(spots) else size
            before = bisect_left(spots, s - n // 2) - 1
            start = spots[before] + n if before >= 0 else 0
            for lo, hi in ((s, s + n), (s, s + least), (s - 1, s + n + 1), (s - slack, s + n + slack), (s - slack, min(end, s + n + slack)), (max(min(start, s), s - slack), min(end, s + n + slack))):
                lo, hi = max(0, lo), min(size, hi)
                if hi > lo and (lo, hi) not in seen:
                    seen.add((lo, hi))
                    yield lo, hi


SCANNED = (
    "doc_id long, license string, coverage double, n_aligned long, first_word long, last_word long, "
    "licenses array<struct<license:string,coverage:double,n_aligned:long,first_word:long,last_word:long>>"
)
_HIT = pa.struct(
    [("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
)


def _scan(scanner: Scanner):
    names = [f.name for f in _HIT]

    def run(batches):
        for batch in batches:
            hits = [[dict(zip(names, h, strict=True)) for h in scanner.scan(t)] for t in batch.column("text").to_pylist()]
            # The most words, then the largest share, then the name.
            best = [min(h, key=lambda x: (-x["n_aligned"], -x["coverage"], x["license"]), default={}) for h in hits]
            cols = [pa.array([b.get(f.name) for b in best], f.type) for f in _HIT]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *cols, pa.array(hits, pa.list_(_HIT))], names=["doc_id", *names, "licenses"]
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_aligned, first_word, last_word, licenses): a row for each row of docs.

    licenses: every place of the whole text, none of one template overlapping,
    round which at least the share `coverage` of a template's words aligns, and
    as large a share of the words of that place with it; the
    other columns repeat the one with the most aligned words (then the largest
    coverage, then the first name), null where there is none, as for null and
    empty texts.  Templates without words are left out.  Other columns of docs
    don't matter; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(Scanner(TEMPLATES if templates is None else templates, coverage)), SCANNED)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "license", "coverage", "n_aligned", "first_word", "last_word", F.size("licenses").cast("long").alias("n_licenses")
    )
