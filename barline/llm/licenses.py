"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are normalised to lower-case words without punctuation and
cut into five-word shingles. Templates form classes of like length; for a class
the text is covered by overlapping windows of the longest template's length,
one starting at every stride. A window holding ``CONTAINED`` of a template's
shingles has Jaccard similarity J to it; with b bands of one row each the
window's MinHash meets the template's in some band with probability
1 - (1 - J)^b. ``bands_for`` picks b so that this is at least 1 - ``MISS``.
Shingles of text and template then decide: no estimate enters the result.
Templates of under five words are a single shingle, their whole word sequence,
and are looked up word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import map_arrow, tune

WIDTH, CONTAINED, MISS, MAX_BANDS = 5, 0.8, 1e-9, 64
#: Notices by which works name their licence.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Notices of further licences, and the one of under five words.
MORE_TEMPLATES = {
    "proprietary": ["All rights reserved."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
ALL_TEMPLATES = TEMPLATES | MORE_TEMPLATES
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _PUNCTUATION, bytes(range(97, 123)) + b" " * len(_PUNCTUATION))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of every run of ``width`` word hashes; one of the whole sequence where there are fewer."""
    n = len(h) - width + 1
    if n < 1:
        h, n, width = h, min(1, len(h)), len(h)
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(width if n > 0 else 0):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def bands_for(jaccard: float, miss: float = MISS) -> int:
    """Bands of one row that miss a pair of this similarity with probability ``miss`` at most."""
    return max(1, int(np.ceil(np.log(miss) / np.log(1 - min(jaccard, 1 - 1e-6)))))


@dataclass
class _Class:
    """Templates of like length: shingles in a window, stride, and each band's template MinHashes, sorted."""

    window: int
    stride: int
    bands: int
    marks: list[np.ndarray]
    table: np.ndarray
    members: list[int]


class Scanner:
    """Finds templates in texts. ``templates``: licence id to its notices."""

    def __init__(self, templates: dict[str, list[str]], contained: float = CONTAINED):
        self.contained = contained
        self.names, self.words, self.sets = [], [], []
        self.short: list[tuple[str, list[bytes], int]] = []
        for name in sorted(templates):
            for t in templates[name]:
                w = words_of(t)
                if len(w) >= WIDTH:
                    self.names.append(name)
                    self.words.append(w)
                    self.sets.append(set(zip(*(w[i:] for i in range(WIDTH)), strict=False)))
                elif w:
                    self.short.append((name, w, max(range(len(w)), key=lambda i: len(w[i]))))
        self.hashes = _Hashes()
        rng = np.random.default_rng(7)
        self.odd = rng.integers(1, 2**63, MAX_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sizes = [len(w) - WIDTH + 1 for w in self.words]
        self.classes: list[_Class] = []
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        while order:
            low = sizes[order[0]]
            members = [i for i in order if sizes[i] <= max(low + 1, 1.3 * low)]
            order = order[len(members) :]
            longest = max(sizes[i] for i in members)
            stride = max(1, low // 8)
            window = -(-(longest + stride - 1) // stride) * stride  # some window holds any stretch of the longest's length whole
            worst = contained * low / (window + (1 - contained) * low)
            bands = bands_for(worst)
            if bands > MAX_BANDS:
                raise ValueError(f"{bands} bands are needed for a containment of {contained}, more than {MAX_BANDS}")
            marks = [np.unique([self._band(self._shingles(self.words[i]), b).min() for i in members]) for b in range(bands)]
            table = np.zeros((bands, 1 << 16), dtype=bool)
            for b, m in enumerate(marks):
                table[b, (m & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.classes.append(_Class(window, stride, bands, marks, table, members))

    def _shingles(self, words: list[bytes]) -> np.ndarray:
        return shingle_hashes(np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words)))

    def _band(self, s: np.ndarray, b: int) -> np.ndarray:
        x = s * self.odd[b]
        return x ^ (x >> np.uint64(32))

    def _windows(self, s: np.ndarray, c: _Class) -> np.ndarray:
        """First shingles of the windows that meet a template of the class in some band."""
        hit = np.zeros(-(-len(s) // c.stride), dtype=bool)
        for b in range(c.bands):
            x = self._band(s, b)
            # minimum over blocks of a stride, then over the blocks that a window takes, doubling
            if c.stride > 1:
                x = np.minimum.reduceat(x, np.arange(0, len(x), c.stride))
            need, have = c.window // c.stride, 1
            while have < need:
                step = min(have, need - have)
                if len(x) > step:
                    x = np.r_[np.minimum(x[:-step], x[step:]), x[-step:]]
                have += step
            at = np.flatnonzero(c.table[b, (x & np.uint64(0xFFFF)).astype(np.int64)])
            at = at[np.isin(x[at], c.marks[b])]
            hit[at] = True
        return np.flatnonzero(hit) * c.stride

    def scan_many(self, texts: list[str | None], together: int = 50_000) -> list[list[tuple[str, int, int, float]]]:
        """For each text (licence, first word, last word, containment) of every place that holds a template, in order.

        Texts are hashed together for speed; a window that reaches into the next text is verified in both.
        """
        out: list[list[tuple[str, int, int, float]]] = []
        group: list[list[bytes]] = []
        size = 0
        for t in texts:
            group.append(words_of(t))
            size += len(group[-1])
            if size >= together:
                out += self._scan(group)
                group, size = [], 0
        return out + self._scan(group)

    def _scan(self, texts: list[list[bytes]]) -> list[list[tuple[str, int, int, float]]]:
        shingles = [self._shingles(w) if len(w) >= WIDTH else np.empty(0, np.uint64) for w in texts]
        starts = np.cumsum([0, *map(len, shingles)])
        found: list[dict[tuple[str, int], tuple[str, int, int, float]]] = [{} for _ in texts]
        s = np.concatenate([np.empty(0, np.uint64), *shingles])
        for c in self.classes if len(s) else []:
            span = c.window + 2 * c.stride
            for a in self._windows(s, c).tolist():
                lo, hi = max(0, a - c.stride), min(len(s), a + span)
                first = int(np.searchsorted(starts, lo, side="right")) - 1
                for d in range(first, len(texts)):
                    if starts[d] >= hi:
                        break
                    if len(shingles[d]):
                        self._verify(c, texts[d], max(0, lo - int(starts[d])), min(len(shingles[d]), hi - int(starts[d])), found[d])
        for words, x in zip(texts, found, strict=True):
            self._look_up(words, x)
        return [self._merged(x) for x in found]

    def _look_up(self, words: list[bytes], found: dict[tuple[str, int], tuple[str, int, int, float]]) -> None:
        """Short templates, by their longest word."""
        for name, want, at in self.short:
            for i in range(words.count(want[at])):
                p = words.index(want[at], p + 1 if i else 0)
                a = p - at
                if a >= 0 and words[a : a + len(want)] == want:
                    old = found.get((name, a))
                    if old is None or (1.0, a + len(want) - 1) > (old[3], old[2]):
                        found[name, a] = (name, a, a + len(want) - 1, 1.0)

    def _verify(self, c: _Class, words: list[bytes], lo: int, hi: int, found: dict[tuple[str, int], tuple[str, int, int, float]]) -> None:
        """Places in shingles lo to hi of a text: a template's shingle from which on as many shingles as it has hold enough of them.

        That depends on the text alone; a place cut off by hi is whole in the
        range of the window that holds it whole.
        """
        here = list(zip(*(words[lo + i : hi + i] for i in range(WIDTH)), strict=False))
        for m in c.members:
            want = self.sets[m]
            places = [i for i, x in enumerate(here) if x in want]
            if len(places) < self.contained * len(want):
                continue
            size = len(self.words[m]) - WIDTH + 1
            for k, p in enumerate(places):
                held = [q for q in places[k : k + size] if q < p + size]
                share = len({here[q] for q in held}) / len(want)
                if share >= self.contained:
                    hit = (self.names[m], lo + p, lo + held[-1] + WIDTH - 1, share)
                    old = found.get(hit[:2])
                    if old is None or (share, hit[2]) > (old[3], old[2]):
                        found[hit[:2]] = hit

    def _merged(self, found: dict[tuple[str, int], tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        best: list[tuple[str, int, int, float]] = []
        for x in sorted(found.values(), key=lambda x: (x[0], x[1], -x[3])):  # overlapping finds of one licence are one
            if best and best[-1][0] == x[0] and x[1] <= best[-1][2]:
                p = best[-1]
                best[-1] = (p[0], p[1], max(p[2], x[2]), max(p[3], x[3]))
            else:
                best.append(x)
        return sorted(best, key=lambda x: (x[1], x[0]))


_SCANNERS: dict[str, Scanner] = {}


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licenses, n_matches, matches), a row for each row of ``docs``.

    ``licenses``: the distinct licences found, sorted; ``matches``: array of
    (license, first_word, last_word, containment) in text order, words counted
    after folding. Templates of under five words match as a whole. A null or empty
    text has no match; repeated rows give the same; an empty table gives
    an empty result. ``templates`` is a bounded set held by every worker.
    """
    tune(docs.sparkSession)
    wanted = templates or TEMPLATES
    name = repr(sorted(wanted.items()))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _SCANNERS.get(name)
        if scanner is None:
            scanner = _SCANNERS[name] = Scanner(wanted)
        got = scanner.scan_many(b.column(1).to_pylist())
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("containment", pa.float64())]))
        rows = [[dict(zip(("license", "first_word", "last_word", "containment"), m, strict=True)) for m in x] for x in got]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted({m[0] for m in x}) for x in got], pa.list_(pa.string())), pa.array([len(x) for x in got], pa.int64()), pa.array(rows, kind)], names=["doc_id", "licenses", "n_matches", "matches"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, "doc_id long, licenses array<string>, n_matches long, matches array<struct<license:string,first_word:int,last_word:int,containment:double>>", run)
