"""License scans: winnowed template fingerprints for exact occurrences, word counts and alignment for changed ones (operator 6)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type
from .decontaminate import words

GRAM, WINNOW = 5, 4
MIN_COVERAGE = 0.8
#: Template text handled at a time; its index (some ten times as large) is broadcast. More text, more passes.
SLICE_BYTES = 1 << 20
MATCH, MISS, GAP = 2, -1, -1
_BIG = np.iinfo(np.uint64).max
# the same words as decontaminate.words, on code points
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

# Notices as licensors publish them.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("mit-line", "Released under the MIT License."),
    (
        "mit-permission",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    (
        "isc-permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
]


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word numbers; the largest value where one of them is 0 (no template's word)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part > 0
    h[~known] = _BIG
    return h


def winnow(h: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Positions of the smallest hash of every window of `width` (the last on ties); all, if there is no whole window."""
    if len(h) < width:
        return np.flatnonzero(h != _BIG)
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    at = np.unique(np.arange(len(windows)) + width - 1 - windows[:, ::-1].argmin(axis=1))
    return at[h[at] != _BIG]


@dataclass
class Index:
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    postings: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # gram size -> hash -> (template, place)

    def add(self, name: str, text: bytes | None) -> None:
        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
        if not len(ids):
            return
        self.names.append(name)
        self.texts.append(ids)
        size = min(GRAM, len(ids))
        h = gram_hashes(ids, size)
        # a template too short for a sure common window keeps all its grams
        for at in winnow(h) if len(h) >= 2 * WINNOW else range(len(h)):
            self.postings.setdefault(size, {}).setdefault(int(h[at]), []).append((len(self.names) - 1, int(at)))


    @cached_property
    def bags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of all templates, one template after the other; how often each stands there; where templates begin; words needed."""
        parts = [np.unique(t, return_counts=True) for t in self.texts]
        begins = np.cumsum([0, *[len(w) for w, _ in parts[:-1]]])
        return np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]), begins, np.array([needed(len(t)) for t in self.texts])

    def likely(self, ids: np.ndarray) -> np.ndarray:
        """Templates of whose words, repeats counted, the text holds enough in any order: no other can be covered."""
        terms, times, begins, need = self.bags
        have = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        return np.flatnonzero(np.add.reduceat(np.minimum(have[terms], times), begins) >= need)


def needed(m: int) -> int:
    """The least number of matched words that is MIN_COVERAGE of m."""
    return next(n for n in range(max(0, math.floor(MIN_COVERAGE * m) - 1), m + 1) if n >= MIN_COVERAGE * m)


def fit(template: np.ndarray, doc: np.ndarray, band: tuple[int, int]) -> tuple[int, int, int, int]:
    """(score, matched words, first and last matched place in doc) of the best fit of the whole template into part of doc.

    Of equal scores the one with most matches. Only cells with
    band[0] <= doc place - template place <= band[1] are visited.
    """
    low, high = band
    one, none = 1 << 31, -(1 << 61)  # a cell is score * one + matches
    j = np.arange(len(doc) + 1)
    key, first, last = np.where((j < low) | (j > high), none, 0), np.full(len(j), -1), np.full(len(j), -1)
    for i, want in enumerate(template, 1):
        hit = doc == want
        down = key + GAP * one
        step = key[:-1] + np.where(hit, MATCH * one + 1, MISS * one)
        take = step >= down[1:]
        new_first, new_last = first.copy(), last.copy()
        new_first[1:] = np.where(take, np.where(hit & (first[:-1] < 0), j[:-1], first[:-1]), first[1:])
        new_last[1:] = np.where(take, np.where(hit, j[:-1], last[:-1]), last[1:])
        down[1:] = np.where(take, step, down[1:])
        outside = (j - i < low) | (j - i > high)
        down[outside] = none
        # words of doc left out: the best cell before, less a gap a word
        level = down - GAP * one * j
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, j, 0))
        key, first, last = top + GAP * one * j, new_first[source], new_last[source]
        key[outside] = none
    best = int(key.argmax())
    return int(key[best]) >> 31, int(key[best]) & one - 1, int(first[best]), int(last[best])


def align(template: np.ndarray, doc: np.ndarray, band: tuple[int, int]) -> tuple[int, int, int]:
    """(matched words, first and last matched place in doc) of the best fit within the band."""
    return fit(template, doc, band)[1:]


def stretches(text: np.ndarray, ids: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Parts of ids[low:high] that hold every occurrence with enough coverage and a positive score.

    Such an occurrence is under three times the template's length, and enough of the
    template's words stand in it.
    """
    m, need = len(text), needed(len(text))
    at = low + np.flatnonzero(np.isin(ids[low:high], text))
    if len(at) < need:
        return []
    begins, ends = at[: len(at) - need + 1], at[need - 1 :] + 1
    close = ends - begins < 3 * m
    begins, ends = begins[close], ends[close]
    if not len(begins):
        return []
    new = np.flatnonzero(begins[1:] >= ends[:-1]) + 1
    out = list(zip(begins[np.r_[0, new]].tolist(), ends[np.r_[new - 1, len(ends) - 1]].tolist(), strict=True))
    terms, times = np.unique(text, return_counts=True)
    enough = lambda part: np.minimum(np.bincount(part, minlength=terms[-1] + 1)[terms], times).sum() >= need
    return [(a, b) for a, b in out if enough(ids[a:b])]


def scan(index: Index, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first, last word place) of each occurrence with enough coverage.

    Exact occurrences come from the fingerprints. The others are the best fits, best
    first, of the template into what is left of the text, if twice the matched words
    outnumber those changed, left out or put between.
    """
    exact: dict[int, set[int]] = {}
    for size, table in index.postings.items():
        h = gram_hashes(ids, size)
        # only grams wholly of template words are left here; all are looked up, so that kept grams of short templates meet too
        for at in np.flatnonzero(h != _BIG):
            for template, place in table.get(int(h[at]), ()):
                exact.setdefault(template, set()).add(int(at) - place)
    found = []
    for template in index.likely(ids).tolist() if index.texts else ():
        text, m = index.texts[template], len(index.texts[template])
        here = [s for s in sorted(exact.get(template, ())) if s >= 0 and np.array_equal(ids[s : s + m], text)]
        found += [(template, m, s, s + m - 1) for s in here]
        todo = list(zip([0, *[s + m for s in here]], [*here, len(ids)], strict=True))
        while todo:
            for low, high in stretches(text, ids, *todo.pop()):
                score, n, first, last = fit(text, ids[low:high], (-m, high - low))
                if n >= MIN_COVERAGE * m and score > 0:
                    found.append((template, n, low + first, low + last))
                if n:
                    todo += [(low, low + first), (low + last + 1, high)]
    return sorted(found, key=lambda x: (x[2], x[0]))


def indexes(templates: DataFrame) -> Iterator[Index]:
    """Templates in parts of about SLICE_BYTES; the driver holds one part at a time."""
    part, size = Index(), 0
    for r in templates.select(F.col("template_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        part.add(r["name"], bytes(r.text) if r.text is not None else None)
        size += len(r.text or b"")
        if size >= SLICE_BYTES:
            yield part
            part, size = Index(), 0
    if part.names:
        yield part


FOUND = "template_id string, matched_words long, template_words long, coverage double, span_start long, span_end long"


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, template_id, matched_words, template_words, coverage, span_start, span_end: a row per occurrence.

    templates(template_id, text). Words are A-Z lower-cased runs of letters and digits.
    Spans are code points of the whole source text, end exclusive, from the first to the
    last matched word; coverage is the share of the template's words that align. Null,
    empty and matchless texts give no row; repeated rows report again; equal templates
    each report; either table may be empty; other columns are ignored. Nothing is
    shuffled: every document is scanned where it is read.
    """
    context, out = docs.sparkSession.sparkContext, None
    found_as = f"doc_id {id_type(docs)}, {FOUND}"
    names = [x.split()[0] for x in found_as.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for part in indexes(templates):
        shared = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            get = index.vocabulary.get
            for batch in batches:
                rows = []
                for row, text in enumerate(batch.column(1).cast(pa.binary())):
                    data = text.as_py()
                    ids = np.array([get(w, 0) for w in words(data)], np.int64)
                    found = scan(index, ids) if ids.any() else []
                    if found:
                        at = [m.span() for m in _WORD.finditer(data.decode())]
                        rows += [(row, index.names[t], n, len(index.texts[t]), n / len(index.texts[t]), at[a][0], at[b][1]) for t, n, a, b in found]
                own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1)]], names)

        here = docs.select("doc_id", "text").mapInArrow(run, found_as)
        out = here if out is None else out.unionAll(here)
    return docs.sparkSession.createDataFrame([], found_as) if out is None else out
