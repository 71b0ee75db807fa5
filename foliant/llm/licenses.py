"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates (notices, and whole license texts from ``license_texts``) are read as words; hashes of word triples are winnowed (Schleimer et al., 2003)
and put in an inverted index from triple to template and place.  A document's triples are looked up there; hits near one
diagonal make a candidate, which is aligned with its template inside a band.  A match reports how much of the template
it covers and where it stands in the document.  Hits that a match explains are taken away and the others tried again, so
that notices which follow each other are all found.  An SPDX tag is a template of two words, looked up as such.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import texts

#: Words of a fingerprint, and fingerprints of a winnowing window: a run of WIDTH + WINDOW - 1 words is always seen.
WIDTH, WINDOW = 3, 2
COVERAGE = 0.8
#: Templates with more words are candidates only where one in FEW of their fingerprints is hit. Three fingerprints hold a
#: word, so that a fifth of the words missing leaves more than that.
LONG, FEW = 50, 16
#: Band cells from which an alignment goes row by row in numpy.
CELLS = 4_000
TAG = "spdx-license-identifier"
WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
MATCHED = "doc_id long, license string, template string, matched int, coverage double, start int, end int"

# Licenses by SPDX identifier, the names that notices give them, and the words of a name that tell it
# from the other names.
NAMES = {
    "MIT": (["MIT License"], ["mit"]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0"], ["apache", "2.0"]),
    "GPL-2.0": (["GNU General Public License, version 2", "GNU GPL v2"], ["gnu", ("2", "v2")]),
    "GPL-3.0": (["GNU General Public License, version 3", "GNU GPL v3"], ["gnu", ("3", "v3")]),
    "LGPL-2.1": (["GNU Lesser General Public License, version 2.1"], ["lesser", "2.1"]),
    "LGPL-3.0": (["GNU Lesser General Public License, version 3"], ["lesser", "3"]),
    "AGPL-3.0": (["GNU Affero General Public License, version 3"], ["affero", "3"]),
    "MPL-2.0": (["Mozilla Public License, Version 2.0"], ["mozilla", "2.0"]),
    "EPL-2.0": (["Eclipse Public License 2.0"], ["eclipse", "2.0"]),
    "BSD-2-Clause": (["BSD 2-Clause License"], ["bsd", "2-clause"]),
    "BSD-3-Clause": (["BSD 3-Clause License"], ["bsd", "3-clause"]),
    "ISC": (["ISC License"], ["isc"]),
    "CC0-1.0": (["CC0 1.0 Universal"], ["cc0"]),
    "CC-BY-4.0": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], [("by", "attribution"), "4.0"]),
    "CC-BY-SA-4.0": (["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], [("by-sa", "attribution-sharealike"), "4.0"]),
    "CC-BY-NC-4.0": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], [("by-nc", "attribution-noncommercial"), "4.0"]),
    "CC-BY-ND-4.0": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], [("by-nd", "attribution-noderivatives"), "4.0"]),
    "CC-BY-NC-SA-4.0": (["CC BY-NC-SA 4.0"], ["by-nc-sa", "4.0"]),
    "CC-BY-NC-ND-4.0": (["CC BY-NC-ND 4.0"], ["by-nc-nd", "4.0"]),
}
PHRASES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under the terms of {}", "Available under {}"]
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


@dataclass(frozen=True)
class Template:
    license: str
    name: str
    words: tuple[str, ...]
    #: Words, or choices of words, that a match must cover.
    keys: tuple[frozenset[str], ...]


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in WORD.findall(text))


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    out = []
    for spdx, (names, keys) in NAMES.items():
        wanted = [frozenset([k] if isinstance(k, str) else k) for k in keys]
        for i, name in enumerate(names):
            article = "" if name.startswith(("CC ", "CC0")) or name.startswith("GNU GPL v") else "the "
            for j, phrase in enumerate(PHRASES):
                words = _words(phrase.format(article + name))
                out.append(Template(spdx, f"notice-{i}-{j}", words, tuple(k for k in wanted if k & set(words))))
    out += [Template(spdx, "text", _words(text), (frozenset([{"GPL-2.0": "2", "GPL-3.0": "3"}[spdx]]),) if spdx.startswith("GPL") else ()) for spdx, text in TEXTS.items()]
    whole = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    out += [Template(f.stem, "whole", _words(f.read_text(encoding="utf-8")), ()) for f in whole]
    return tuple(out)


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the fingerprints kept: the rightmost smallest of every window."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


class Scanner:
    def __init__(self, known: tuple[Template, ...] | None = None, coverage: float = COVERAGE):
        self.templates, self.coverage = known if known is not None else templates(), coverage
        vocabulary = sorted({w for t in self.templates for w in t.words})
        self.ids = {w: i for i, w in enumerate(vocabulary, 1)}
        self.base = len(vocabulary) + 1
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, t in enumerate(self.templates):
            triples = self._triples(np.array([self.ids[w] for w in t.words], np.int64))
            for at in winnow([int(x) * 0x9E3779B97F4A7C15 % (1 << 64) for x in triples]):
                index[int(triples[at])].append((number, at))
        self.index = dict(index)
        self.fingerprints = Counter(number for found in index.values() for number, _ in found)

    def _triples(self, ids: np.ndarray) -> np.ndarray:
        """One number for each run of WIDTH known words, -1 where a word is unknown."""
        n = len(ids) - WIDTH + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(WIDTH):
            out = out * self.base + ids[i : i + n]
            known &= ids[i : i + n] > 0
        return np.where(known, out, -1)

    def align(self, template: tuple[str, ...], words: list[str], diagonal: int, band: int) -> list[tuple[int, int]]:
        """Pairs (template place, word place) of equal words on the best path that uses the whole template.

        Word places lie within ``band`` of ``diagonal`` + template place; words before and after are free.
        """
        width = 2 * band + 1
        if width * len(template) > CELLS:
            return self._align_rows(template, words, diagonal, band)
        score, moves = [0] * width, []
        for i, w in enumerate(template):
            now, step = [0] * width, bytearray(width)
            for k in range(width):
                j = diagonal + i + k - band
                inside = 0 <= j < len(words)
                same = inside and words[j] == w
                best, move = score[k] + (2 if same else -1), 3 if same else 2
                if k + 1 < width and score[k + 1] - 1 > best:
                    best, move = score[k + 1] - 1, 1  # the template's word is missing
                if inside and k and now[k - 1] - 1 > best:
                    best, move = now[k - 1] - 1, 4  # a word too many
                now[k], step[k] = best, move
            score = now
            moves.append(step)
        return self._path(score, moves, diagonal, band)

    @staticmethod
    def _path(score, moves, diagonal: int, band: int) -> list[tuple[int, int]]:
        k, i, pairs = max(range(len(score)), key=lambda k: (score[k], -abs(k - band))), len(moves) - 1, []
        while i >= 0:
            move = moves[i][k]
            if move == 4:
                k -= 1
                continue
            if move == 3:
                pairs.append((i, diagonal + i + k - band))
            if move == 1:
                k += 1
            i -= 1
        return pairs[::-1]

    def _align_rows(self, template: tuple[str, ...], words: list[str], diagonal: int, band: int) -> list[tuple[int, int]]:
        """As :meth:`align`; surplus words, which depend on their left neighbour, by a running maximum."""
        width, n = 2 * band + 1, len(template)
        ids: dict[str, int] = {}
        own = np.array([ids.setdefault(w, len(ids)) for w in template])
        low = diagonal - band
        text = np.full(n + width, -1)
        for j in range(max(0, low), min(len(words), low + n + width)):
            text[j - low] = ids.get(words[j], -1)
        place = np.arange(width)
        score, moves = np.zeros(width, np.int64), np.zeros((n, width), np.uint8)
        for i in range(n):
            same = text[i : i + width] == own[i]
            best = score + np.where(same, 2, -1)
            step = np.where(same, 3, 2).astype(np.uint8)
            missing = np.r_[score[1:] - 1, -(1 << 40)]
            step[missing > best] = 1
            best = np.maximum(best, missing)
            j = low + i + place
            inside = (j >= 0) & (j < len(words))
            # Places outside the text lie at the ends of the band: a run of surplus words never crosses one.
            lifted = np.where(inside | (j < 0), best + place, -(1 << 40))
            first = int(np.argmax(inside)) if inside.any() else width
            run = np.maximum.accumulate(lifted[max(first - 1, 0) :]) - place[max(first - 1, 0) :]
            now = best.copy()
            now[max(first - 1, 0) :] = np.where(inside[max(first - 1, 0) :], np.maximum(run, best[max(first - 1, 0) :]), best[max(first - 1, 0) :])
            step[now > best] = 4
            score, moves[i] = now, step
        return self._path(score.tolist(), moves, diagonal, band)

    def hits(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each template the (diagonal, word place) of its fingerprints in the text."""
        get = self.ids.get
        triples = self._triples(np.array([get(w, 0) for w in words], np.int64))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in np.flatnonzero(triples >= 0).tolist():
            for number, place in self.index.get(int(triples[at]), ()):
                hits[number].append((at - place, at))
        return hits

    def found(self, number: int, hits: list[tuple[int, int]], words: list[str]) -> Iterator[tuple[int, float, int, int, int]]:
        """(matched words, coverage, template, first and last word) of every match of a template."""
        t = self.templates[number]
        n = len(t.words)
        slack = 4 + n // 5
        left = sorted(hits)
        while left:
            near = [h for h in left[: bisect_right(left, (left[0][0] + slack, len(words)))]]
            often = Counter(d for d, _ in near)
            if n > LONG and FEW * len(near) < self.fingerprints[number]:
                left = left[len(near) :]
                continue
            diagonal = min(often, key=lambda d: (-often[d], d))
            pairs = []
            around = set(words[max(0, diagonal - slack) : diagonal + n + slack])
            if all(k & around for k in t.keys):
                # A text that follows its template has no more surplus or missing words than the diagonals tell.
                band = slack if n <= LONG else min(slack, 16 + max(abs(d - diagonal) for d in often))
                pairs = self.align(t.words, words, diagonal, band)
            covered = {t.words[i] for i, _ in pairs}
            if len(pairs) >= self.coverage * n and all(k & covered for k in t.keys):
                first, last = pairs[0][1], pairs[-1][1]
                yield len(pairs), len(pairs) / n, number, first, last
                left = [h for h in left if not first <= h[1] <= last and h[0] != diagonal]
            elif n > LONG:  # the band takes in all these hits, and another copy lies further away than they reach
                left = left[len(near) :]
            else:
                left = [h for h in left if h[0] != diagonal]

    def scan(self, text: str) -> list[tuple[str, str, int, float, int, int]]:
        """(license, template, matched words, coverage, start, end) of every match, in order of its start."""
        matches = list(WORD.finditer(text))
        raw = [m[0] for m in matches]
        words = [w.lower() for w in raw]
        found = [m for number, hits in self.hits(words).items() for m in self.found(number, hits, words)]
        taken: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            if not any(min(m[4], o[4]) - max(m[3], o[3]) >= 0 for o in taken):
                taken.append(m)
        out = [(self.templates[n].license, self.templates[n].name, count, share, matches[a].start(), matches[b].end()) for count, share, n, a, b in taken]
        if TAG in words:
            tags = (i for i, w in enumerate(words[:-1]) if w == TAG)
            out += [(raw[i + 1], "spdx-tag", 2, 1.0, matches[i].start(), matches[i + 1].end()) for i in tags]
        return sorted(out, key=lambda m: m[4])


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for m in scanner().scan(t)]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in MATCHED.split(", ")])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each license notice or text in ``docs`` (``doc_id``, ``text``; others are ignored).

    ``doc_id, license`` (SPDX), ``template``, ``matched`` words, ``coverage`` of the template (0.8 at least), and the
    span ``start``, ``end`` in code points of the whole text.  Of matches that overlap, the one with most words counts.
    Null and empty texts have no matches; repeated rows all give theirs; an empty table gives an empty one.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, MATCHED)
