"""Licence scans: winnowed fingerprints find candidates, alignment confirms them.

Templates are split into words; of each window of word pairs the one with the
smallest hash is kept in an inverted index, which every pair of a text is looked up
in. Only templates with a hit, and only diagonals near one of their hits, are
candidates; of these, places where too few of a template's words stand in the band
cannot match and leave. A banded alignment of the template with the words around a
candidate gives matched words and the span.

A template's window is as wide as its length allows: a match that has ``least`` of
its words and breaks at no more than one and a half times as many places (changed,
lost or added words) as that leaves words over has a run of words that holds a
whole window, and so a fingerprint. The longest run such a match must have is three
words for most templates, two for the shortest lines.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Notices as licences and public guides word them.
NOTICES = {
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit/line": "Released under the MIT License",
    "mit/line-2": "This project is licensed under the MIT License",
    "mit/permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "bsd/redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3",
    "gpl/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by/line": "Licensed under CC BY 4.0",
    "cc-by-nc/line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "isc/permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd/notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "lgpl/notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ),
    "agpl/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "gpl-2.0/notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ),
    "boost-1.0/notice": "Distributed under the Boost Software License, Version 1.0",
    "bsd/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
}
#: Identifiers that stand in a line of their own kind.
IDENTIFIERS = [
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """Whole licences, one file each in ``licences/`` beside this module, notices
    and identifier lines."""
    texts = {f"{p.name[:-4]}/text": p.read_text(encoding="utf-8") for p in sorted((resources.files(__package__) / "licences").iterdir(), key=lambda p: p.name)}
    return texts | NOTICES | {f"{i.lower()}/spdx": f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS}


EPS = 1e-9
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


class Index:
    """Templates of two words or more, for matches of ``least`` of their words."""

    def __init__(self, templates: dict[str, str], least: float = 0.8, k: int = 2, band: int = 6) -> None:
        self.k, self.band, self.names = k, band, list(templates)
        self.words: dict[str, int] = {}
        self.tokens = [np.array([self.words.setdefault(w.lower(), len(self.words) + 1) for w in WORD.findall(t)], dtype=np.int64) for t in templates.values()]
        #: The inverted index: fingerprints, which templates have them, and by template where.
        self.postings: dict[int, set[int]] = {}
        self.prints: list[tuple[np.ndarray, np.ndarray]] = []
        for t, tokens in enumerate(self.tokens):
            grams, picked, window = self.grams(tokens), set(), self.window(len(tokens), least)
            for i in range(max(1, len(grams) - window + 1) if len(grams) else 0):
                part = grams[i : i + window]
                picked.add(i + len(part) - 1 - int(part[::-1].argmin()))  # the rightmost smallest
            at = np.array(sorted(picked, key=lambda i: (grams[i], i)), dtype=np.int64)
            self.prints.append((grams[at], at))
            for i in picked:
                self.postings.setdefault(int(grams[i]), set()).add(t)
        self.known = np.array(sorted(self.postings), dtype=np.int64)
        self.holders = np.zeros((len(self.known), len(self.tokens)), dtype=bool)
        for row, gram in zip(self.holders, self.known.tolist(), strict=True):
            row[list(self.postings[gram])] = True
        self.share = np.zeros((len(self.tokens), len(self.words) + 1), dtype=np.int64)  # places of a word in a template
        self.places: list[tuple[np.ndarray, np.ndarray]] = []  # the places by word, and where each word's begin
        for t, tokens in enumerate(self.tokens):
            np.add.at(self.share[t], tokens, 1)
            self.places.append((np.argsort(tokens, kind="stable"), np.cumsum(self.share[t]) - self.share[t]))

        self.weight = self.share.astype(np.float32)

    def window(self, size: int, least: float) -> int:
        """Pairs of a window: those of the run that a match must have."""
        need = math.ceil(least * size - EPS)
        breaks = (size - need) * 3 // 2
        return max(1, -(-need // (breaks + 1)) - self.k + 1)

    def grams(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens) - self.k + 1
        h = np.zeros(max(n, 0), dtype=np.uint64)
        for i in range(self.k):
            h = (h * np.uint64(0x100000001B3)) ^ (tokens[i : i + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (h >> np.uint64(1)).astype(np.int64)

    def scan(self, text: str | None, least: float) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) in text order; of matches that overlap
        the one with more matched words, then the larger coverage, stays."""
        text, get = text or "", self.words.get
        tokens = np.array([get(w.lower(), 0) for w in WORD.findall(text)], dtype=np.int64)
        begins = self.candidates(tokens, least)
        if not begins:
            return []
        found = []
        for t, starts in begins.items():
            size = len(self.tokens[t])
            spans: list[tuple[int, int]] = []
            for s in starts:
                if any(a <= s < b for a, b in spans):
                    continue  # inside an aligned span
                lo, hi = max([b for _, b in spans if b <= s], default=0), min([a for a, _ in spans if a > s], default=len(tokens))
                while self.near(self.tokens[t], tokens, np.array([s]), lo, hi)[0] >= least * size - EPS:  # left of a match the band may hold another
                    matched, a, b = self.align(self.tokens[t], tokens, s, lo, hi)
                    if not matched or matched < least * size - EPS:
                        break
                    spans.append((a, b))
                    found.append((matched, matched / size, self.names[t], a, b))
                    hi = a
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        kept: list[tuple] = []
        for f in found:
            if all(f[4] <= g[3] or f[3] >= g[4] for g in kept):
                kept.append(f)
        if not kept:
            return []
        spans = [m.span() for m in WORD.finditer(text)]  # each word is folded by itself, so these are its places
        return sorted([(name, cov, spans[a][0], spans[b - 1][1]) for _, cov, name, a, b in kept], key=lambda x: (x[2], x[3], x[0]))

    def candidates(self, tokens: np.ndarray, least: float) -> dict[int, list[int]]:
        """For each template with a fingerprint in the text the starts around which a
        match can lie: near one of its hits, with enough of its words in the band;
        those on a hit first, then by their words."""
        some = np.flatnonzero(tokens)
        inside = some[: max(0, len(some) - self.k + 1)]
        inside = inside[some[self.k - 1 :] - inside == self.k - 1]  # grams of words that templates have
        if not len(inside) or not len(self.known):
            return {}
        h = self.grams(tokens)[inside]
        found = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[found] == h
        inside, h, found = inside[hit], h[hit], found[hit]
        holds = self.holders[np.unique(found)].any(axis=0)
        present = np.zeros(len(self.words) + 1, dtype=np.float32)
        present[tokens[some]] = 1
        begins: dict[int, list[int]] = {}
        need = [max(1, math.ceil(least * len(t) - EPS)) for t in self.tokens]
        for t in np.flatnonzero(holds & (self.weight @ present >= need)).tolist():
            size, least_words = len(self.tokens[t]), need[t]
            at = some[self.share[t][tokens[some]] > 0]
            if len(at) < least_words:
                continue
            dense = np.flatnonzero(at[least_words - 1 :] - at[: len(at) - least_words + 1] < size + 2 * self.band)
            live = np.zeros(len(at) + 1, dtype=np.int64)
            np.add.at(live, dense, 1)
            np.add.at(live, dense + least_words, -1)
            at = at[np.cumsum(live[:-1]) > 0]
            if not len(at):
                continue
            order, first = self.places[t]
            times = self.share[t][tokens[at]]
            place = order[np.repeat(first[tokens[at]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
            starts, exact = np.unique(np.repeat(at, times) - place, return_counts=True)
            # The words in a band are on its diagonals: too few there, too few in the band.
            upto = np.concatenate([[0], np.cumsum(exact)])
            around = upto[np.searchsorted(starts, starts + self.band, side="right")] - upto[np.searchsorted(starts, starts - self.band)]
            hits = self.diagonals(t, inside, h)
            by_hit = np.searchsorted(hits, starts + self.band, side="right") > np.searchsorted(hits, starts - self.band)
            starts, exact = starts[(around >= least_words) & by_hit], exact[(around >= least_words) & by_hit]
            near = self.near(self.tokens[t], tokens, starts, 0, len(tokens))
            ok, printed = near >= least_words, set(hits.tolist())
            if ok.any():
                ranked = sorted((s not in printed, -n, -e, s) for s, n, e in zip(starts[ok].tolist(), near[ok].tolist(), exact[ok].tolist(), strict=True))
                begins[t] = [x[3] for x in ranked]
        return begins

    def diagonals(self, t: int, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Where the template would begin for each of its fingerprints in the text, rising."""
        known, place = self.prints[t]
        first = np.searchsorted(known, grams)
        times = np.searchsorted(known, grams, side="right") - first
        which = np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return np.unique(np.repeat(at, times) - place[which])

    def near(self, t: np.ndarray, doc: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many words of the template occur in their band around each start."""
        out, rows = np.zeros(len(starts), dtype=np.int64), max(1, (1 << 20) // max(len(t), 1))
        for i in range(0, len(starts), rows):
            where = starts[i : i + rows, None] + np.arange(len(t))[None, :]
            found = np.zeros(where.shape, dtype=bool)
            for d in range(-self.band, self.band + 1):
                x = where + d
                found |= (x >= lo) & (x < hi) & (doc[np.clip(x, 0, len(doc) - 1)] == t[None, :])
            out[i : i + rows] = found.sum(axis=1)
        return out

    def align(self, t: np.ndarray, doc: np.ndarray, start: int, lo: int = 0, hi: int | None = None) -> tuple[int, int, int]:
        """Matched words and the word span of the best alignment of the template
        within ``band`` diagonals of start; words of the text outside are free.
        Only the text's words from lo to before hi can match."""
        hi = len(doc) if hi is None else hi
        b, n = self.band, len(t)
        width = 2 * b + 1
        score = np.zeros(width)
        steps = np.zeros((n + 1, width), dtype=np.int8)
        for i in range(1, n + 1):
            at = start + i - 1 + np.arange(-b, b + 1)
            inside = (at >= lo) & (at < hi)
            same = inside & (doc[np.clip(at, 0, len(doc) - 1)] == t[i - 1])
            diag = score + np.where(same, 1.0, -1.0)
            up = np.append(score[1:], -np.inf) - 0.75
            new = np.maximum(diag, up)
            steps[i] = np.where(diag >= up, np.where(same, 1, 2), 3)
            for d in range(1, width):
                if new[d - 1] - 0.75 > new[d]:
                    new[d], steps[i, d] = new[d - 1] - 0.75, 4
            score = new
        d, i = int(score.argmax()), n
        matched, a, e = 0, None, None
        while i > 0:
            step, at = steps[i, d], start + i - 1 + d - b
            if step == 1:
                matched, a, e = matched + 1, at, at + 1 if e is None else e
            if step in (1, 2):
                i -= 1
            elif step == 3:
                i, d = i - 1, d + 1
            else:
                d -= 1
        return matched, a or 0, e or 0


@lru_cache(maxsize=2)
def compiled(entries: tuple[tuple[str, str], ...], least: float = 0.8) -> Index:
    return Index(dict(entries), least)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per row of docs: (id_col, n_licenses, licenses, coverage, spans).

    licenses are the matched templates in text order, coverage the largest
    share of a template's words that matched (0 if none), spans their
    "template:start:end" in code points, ends exclusive, comma-joined. Every
    word of a text is looked up. Without ``templates`` they are all_templates():
    whole licences, notices and identifiers; a template has two words or more. Null, empty and short texts have none.
    One pass, no shuffle; rows repeat as in docs, ids may be null; other columns
    are not read.
    """
    entries = tuple((templates or all_templates()).items())

    def run(cols: list[list]) -> list:
        index = compiled(entries, least)
        out: list[list] = [[] for _ in range(5)]
        for doc, text in zip(*cols, strict=True):
            found = index.scan(text, least)
            row = (doc, len(found), [f[0] for f in found], max((f[1] for f in found), default=0.0), ",".join(f"{n}:{s}:{e}" for n, _, s, e in found))
            for c, v in zip(out, row, strict=True):
                c.append(v)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "id long, n_licenses long, licenses array<string>, coverage double, spans string", run).withColumnRenamed("id", id_col)
