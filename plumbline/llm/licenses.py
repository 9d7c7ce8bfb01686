"""License notices in documents: candidates from an inverted index of winnowed fingerprints, then banded alignment.

Texts are compared as words: runs of letters and digits in lower case.  Of every few successive word
runs of a template the one with the smallest hash goes into the index.  The edits that the coverage allows leave
some stretch of the template intact; runs and windows are so short that such a stretch always meets an
entry.  Where entries of a template lie on like diagonals of a document, the template
is aligned to the words there within a band, and the alignment tells how much of the template is matched and
where.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.contamination import Postings, mixed, normal_words, runs
from plumbline.llm.words import arrow, portions, texts_of

RUN = 4
WINDOW = 3
COVERAGE = 0.8
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
#: The wording of public notices, which texts are compared with.
TEMPLATES = {
    "MIT (line)": "Released under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD (line)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
FOUND = {
    "doc_id": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "start": pa.int64(), "end": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}
FOUND_SQL = (
    "doc_id long, license string, coverage double, start long, end long, spans array<struct<start: long, end: long>>"
)


def winnowed(keys: np.ndarray, window: int) -> np.ndarray:
    """Places of the runs kept: of each ``window`` successive ones that of the smallest hash, the last of equals."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    hashes = mixed(keys)
    places = np.arange(max(1, len(keys) - window + 1))
    return np.unique([p + len(w) - 1 - int(w[::-1].argmin()) for p in places for w in (hashes[p : p + window],)])


def stretch(n: int, coverage: float) -> int:
    """Words in a row that stay whole in a template of ``n`` words, whichever ones ``coverage`` lets edits change."""
    k = n - max(1, int(np.ceil(coverage * n - 1e-9)))
    return -(-(n - k) // (k + 1))


def align(template: np.ndarray, region: np.ndarray, slack: int) -> list[tuple[int, int]]:
    """Pairs of equal words in a best alignment of the template to a stretch of ``region``.

    Word ``i`` of the template may stand from place ``i`` to ``i + slack`` of the region: the band.  Words of
    the region before and behind the stretch cost nothing, others and those left out or replaced one each.
    """
    n, width = len(template), slack + 1
    padded = np.concatenate([region, np.full(n + slack + 1, -1)])
    cost = np.zeros((n + 1, width), dtype=np.int64)
    line = np.arange(width)
    for i in range(1, n + 1):
        other = cost[i - 1] + (padded[i - 1 : i - 1 + width] != template[i - 1])
        left_out = np.append(cost[i - 1][1:], n + i) + 1
        cost[i] = np.minimum.accumulate(np.minimum(other, left_out) - line) + line
    pairs, i, c = [], n, int(cost[n].argmin())
    while i:
        if c + 1 < width and cost[i, c] == cost[i - 1, c + 1] + 1:
            i, c = i - 1, c + 1
        elif cost[i, c] == cost[i - 1, c] + (padded[i - 1 + c] != template[i - 1]):
            if padded[i - 1 + c] == template[i - 1]:
                pairs.append((i - 1, i - 1 + c))
            i -= 1
        else:
            c -= 1
    return pairs[::-1]


class Scanner:
    """The index of a set of templates, and the search with it."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE) -> None:
        texts = {name: normal_words(text) for name, text in templates.items()}
        self.names = [name for name, words in texts.items() if words]
        words = [texts[name] for name in self.names]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)), 1)}
        self.texts = [np.array([self.number[w] for w in t], dtype=np.int64) for t in words]
        self.base, self.coverage = len(self.number) + 1, coverage
        self.indexes = {}
        intact = [stretch(len(t), coverage) for t in self.texts]
        for size in {min(RUN, whole) for whole in intact}:
            keys, owners, places = [], [], []
            for i, (text, whole) in enumerate(zip(self.texts, intact, strict=True)):
                if min(RUN, whole) == size:
                    key = runs(text, size, self.base)
                    at = winnowed(key, min(WINDOW, whole - size + 1))
                    keys.append(key[at])
                    owners.append(np.full(len(at), i))
                    places.append(at)
            self.indexes[size] = Postings(*(np.concatenate(x) for x in (keys, owners, places)))

    def search(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int, list[dict]]]:
        lists = [normal_words(x) for x in texts]
        bounds = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in lists], out=bounds[1:])
        ids = np.fromiter(map(self.number.get, chain.from_iterable(lists), repeat(0)), dtype=np.int64, count=bounds[-1])
        seeds = [np.zeros((0, 3), dtype=np.int64)]
        for size, index in self.indexes.items():
            if len(ids) < size:
                continue
            usable = np.logical_and.reduce([ids[i : len(ids) - size + 1 + i] > 0 for i in range(size)])
            place = np.nonzero(usable)[0]
            there, number = index.at(runs(ids, size, self.base)[place])
            which, template, offset = index.expand(number)
            at = place[there][which]
            text = np.searchsorted(bounds, at, "right") - 1
            whole = at + size <= bounds[text + 1]
            seeds.append(np.stack([text, template, at - offset - bounds[text]], axis=1)[whole])
        table = np.unique(np.concatenate(seeds), axis=0)
        found, start = [], 0
        while start < len(table):
            text, template, first = table[start].tolist()
            band = max(2, len(self.texts[template]) // 5)
            end = start + 1
            while end < len(table) and (table[end, :2] == table[start, :2]).all() and table[end, 2] - table[end - 1, 2] <= band:
                end += 1
            low, last = first - band, int(table[end - 1, 2]) + band
            stop = min(bounds[text + 1], bounds[text] + last + len(self.texts[template]))
            words = np.concatenate([np.full(max(0, -low), -1), ids[bounds[text] + max(0, low) : stop]])
            if np.isin(words, self.texts[template]).sum() >= self.coverage * len(self.texts[template]):
                pairs = align(self.texts[template], words, last - low)
                if len(pairs) >= self.coverage * len(self.texts[template]) - 1e-9:
                    found.append((text, template, low, pairs))
            start = end
        return [self.told(texts[text], text, template, low, pairs) for text, template, low, pairs in found]

    def told(self, text: str | None, row: int, template: int, low: int, pairs: list[tuple[int, int]]):
        """Spans in code points: matched words that follow one another in both make one span."""
        places = [m.span() for m in WORD.finditer(text or "")]
        spans: list[list[int]] = []
        for k, (i, j) in enumerate(pairs):
            start, end = places[low + j]
            if k and pairs[k - 1] == (i - 1, j - 1):
                spans[-1][1] = end
            else:
                spans.append([start, end])
        coverage = len(pairs) / len(self.texts[template])
        return row, self.names[template], coverage, spans[0][0], spans[-1][1], [{"start": a, "end": b} for a, b in spans]


def licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, license, coverage, start, end, spans)``: a row for each place of each template in each row of ``docs``.

    A place counts if ``coverage`` or more of the template's words are matched there in order; it is sure to be
    met if word insertions, deletions and replacements together are as few as ``coverage`` lets words be
    missing (more, if some are insertions, may leave no run of the index whole).  Spans are in code points, end exclusive.  NULL and empty texts hold nothing; a row that is repeated is
    reported as often; templates without words are left out.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches):
            rows = scanner.search(texts)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            ids = part.column(0).take(pa.array(columns[0], type=pa.int64()))
            yield arrow(dict(zip(FOUND, [ids, *columns[1:]], strict=True)), FOUND)

    return texts_of(docs).mapInArrow(scan, FOUND_SQL)
