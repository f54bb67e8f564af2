"""License scans by patience alignment.

A notice's template is aligned with the text: words that occur once in both are candidates, the longest
increasing subsequence of them are the anchors, and the gaps between anchors are aligned in the same way, after
what is equal at their two ends. Where a gap has no such word, its rarest common word serves. The
coverage is the share of the template's words that are aligned.

Only stretches of a text are looked at in which template words follow each other closely and which hold most of
the template's different words; others cannot reach the coverage. Within a stretch a notice may start at any word, and
stray template words around it belong to none: for every start the longest common subsequence with the template, of
every end at once (bit-parallel), tells the window that can be covered best and densely enough, and that window
is aligned. Whole texts are read.

Defined cases: null, empty and wordless texts have no license; of several licenses the one with the larger coverage, then
with the longer template, then with the smaller name comes first; repeated rows are scanned one by one; further
columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from acrely.llm.common import append
from acrely.llm.decontaminate import words

COVERAGE = 0.8   # of the template's words
DENSITY = 0.6    # of the words between the first and the last aligned one
FIELDS = "licenses array<struct<license:string,coverage:double,matched:int,first:int,last:int>>, n_words long"

# Notices by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice":
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
}


def _increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, given in order of the first numbers, in which the second rise too."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        tails[i:i + 1] = [b]
        at[i:i + 1] = [k]
        before.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: Sequence[bytes], template: Sequence[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), rising in both."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, a_end, b, b_end = open_.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        here, there = Counter(text[a:a_end]), Counter(template[b:b_end])
        common = [w for w in there if w in here]
        if not common:
            continue
        once = {w for w in common if here[w] == 1 and there[w] == 1}
        if not once:
            rare = min(common, key=lambda w: (here[w] * there[w], there[w], w))
            anchors = [(next(i for i in range(a, a_end) if text[i] == rare), next(j for j in range(b, b_end) if template[j] == rare))]
        else:
            place = {template[j]: j for j in range(b, b_end) if template[j] in once}
            anchors = _increasing([(i, place[text[i]]) for i in range(a, a_end) if text[i] in once])
        found += anchors
        for i, j in [*anchors, (a_end, b_end)]:
            open_.append((a, i, b, j))
            a, b = i + 1, j + 1
    return sorted(found)


def stretches(text: Sequence[bytes], vocabulary: set[bytes], gap: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs in which words of the vocabulary follow each other closely."""
    first = last = None
    for i, w in enumerate(text):
        if w in vocabulary:
            if first is not None and i - last > gap + 1:
                yield first, last + 1
                first = None
            first, last = i if first is None else first, i
    if first is not None:
        yield first, last + 1


def windows(text: Sequence[bytes], template: Sequence[bytes], need: int, density: float = DENSITY) -> Iterator[tuple[int, int]]:
    """(first, end) for each start from which `need` template words or more follow in order and densely: its best end."""
    m, bits = len(template), {}
    for j, w in enumerate(template):
        bits[w] = bits.get(w, 0) | 1 << j
    full, opening = (1 << m) - 1, set(template[:m - need + 1])
    for first, w in enumerate(text):
        if w not in opening:
            continue
        row, end, most = full, 0, 0
        for at in range(first, min(len(text), first + int(m / density))):
            hit = row & bits.get(text[at], 0)
            if not hit:
                continue
            row = (row + hit | row - hit) & full
            common = m - row.bit_count()
            if common > most and common >= need and common >= density * (at + 1 - first):
                end, most = at + 1, common
        if end:
            yield first, end


class Scanner:
    """All templates, ready to be looked for."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE, density: float = DENSITY, gap: int | None = None) -> None:
        self.coverage, self.density, self.gap = coverage, density, gap
        self.templates = {name: words(t.encode()) for name, t in templates.items()}
        self.templates = {name: t for name, t in self.templates.items() if t}
        self.vocabulary = {w for t in self.templates.values() for w in t}

    def _reachable(self, present: set[bytes], template: Sequence[bytes]) -> bool:
        return sum(w in present for w in template) >= self.coverage * len(template)

    def _need(self, template: Sequence[bytes]) -> int:
        return next(k for k in range(1, len(template) + 1) if k >= len(template) or k / len(template) >= self.coverage)

    def scan(self, body: bytes | None) -> tuple[list[dict], int]:
        """Licenses found, the best first, and the number of words."""
        text = words(body) if body else []
        present, out = self.vocabulary.intersection(text), []
        for name, template in self.templates.items():
            if not self._reachable(present, template):
                continue
            vocabulary, best, need = set(template), None, self._need(template)
            gap = int(len(template) / self.density) - need if self.gap is None else self.gap
            for first, end in stretches(text, vocabulary, gap):
                part = text[first:end]
                if not self._reachable(vocabulary.intersection(part), template):
                    continue
                for start, stop in windows(part, template, need, self.density):
                    pairs = align(part[start:stop], template)
                    covered = len(pairs) / len(template)
                    low, high = first + start + pairs[0][0], first + start + pairs[-1][0]
                    if covered < self.coverage or len(pairs) < self.density * (high - low + 1):
                        continue
                    if best is None or (covered, low - high) > (best["coverage"], best["first"] - best["last"]):
                        best = {"license": name, "coverage": covered, "matched": len(pairs), "first": low, "last": high}
            if best:
                out.append(best)
        out.sort(key=lambda x: (-x["coverage"], -len(self.templates[x["license"]]), x["license"]))
        return out, len(text)


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", into: str = "_scan",
    keep: Sequence[str] | None = None, coverage: float = COVERAGE, density: float = DENSITY, gap: int | None = None,
) -> DataFrame:
    """`docs` with the struct column `into`: licenses (name, coverage, aligned words, first and last of them), n_words.

    A notice is found if at least the share `coverage` of its words is aligned, if at least the share `density` of the words
    from the first to the last aligned one is, and if nowhere more than `gap` words in a row are foreign to the notice
    (by default as many as the density admits).
    """
    shape = pa.list_(pa.struct([
        ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))

    def start():
        scanner = Scanner(templates, coverage, density, gap)

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            return [pa.array([f for f, _ in found], shape), pa.array([n for _, n in found], pa.int64())]
        return work

    return append(docs, text, start, FIELDS, into, keep)
