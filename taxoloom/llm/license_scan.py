"""License notices: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are texts that a person keeps, so their inverted index is small and travels with the
tasks. A template's fingerprints are the smallest of every few neighbouring word-run hashes; a text
that repeats enough of the template shares some of them. Hits that lie on nearly the same diagonal
are one candidate, and an alignment inside a band around it finds how many of the template's
words are there, and where; what lies beside a match is aligned again. Documents are independent: one pass, no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, text_bytes, windows
from .decontaminate import words_of

#: Words of a hashed run, runs that share one fingerprint, width of the band on each side.
RUN, NEIGHBOURS, BAND = 3, 2, 12
#: Parts of 100 of a template's words that a match covers.
COVERAGE_PERCENT = 80

# Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 or later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def winnow(hashes: np.ndarray, neighbours: int) -> np.ndarray:
    """Places of the smallest hash among every ``neighbours`` in a row; of equal ones the last."""
    if len(hashes) <= neighbours:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, neighbours)
    return np.unique(np.arange(len(rows)) + neighbours - 1 - np.argmin(rows[:, ::-1], axis=1))


class TemplateIndex:
    """Words and fingerprints of all templates."""

    def __init__(
        self, templates: dict[str, str], run: int = RUN, neighbours: int = NEIGHBOURS, percent: int = COVERAGE_PERCENT
    ):
        self.names = sorted(templates)
        self.vocab: dict[bytes, int] = {}
        self.words = [
            np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(templates[n].encode())], np.int64)
            for n in self.names
        ]
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, words in enumerate(self.words):
            if not len(words):
                continue
            # A text with as few of the words as count, none added, has a stretch of this many in a row.
            least = max(-(-percent * len(words) // 100), 1)
            whole = -(-least // (len(words) - least + 1))
            size = min(run, whole)
            hashes = windows(words.astype(np.uint64), size)
            for at in winnow(hashes, max(min(neighbours, whole - size + 1), 1)).tolist():
                found.setdefault(size, {}).setdefault(int(hashes[at]), []).append((k, at))
        self.postings = {size: (np.array(sorted(hashes), np.uint64), hashes) for size, hashes in sorted(found.items())}

    def hits(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template, places in the text and in the template of equal fingerprints."""
        out: dict[int, list[tuple[int, int]]] = {}
        for size, (keys, postings) in self.postings.items():
            if len(codes) < size:
                continue
            # Only runs of words that templates have can be fingerprints of templates.
            places = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(codes > 0, size).all(axis=1))
            if not len(places):
                continue
            hashes = windows(codes.astype(np.uint64), size)[places]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for k in np.flatnonzero(keys[at] == hashes).tolist():
                for template, place in postings[int(hashes[k])]:
                    out.setdefault(template, []).append((int(places[k]), place))
        return out


def align(template: list[int], text: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment near ``text place - template place = diagonal``: matched words, start and stop in the text.

    A match scores 2, a replaced, missing or added word -1; cells off the band are not filled.
    """
    empty = (0, 0, 0, 0)  # score, matched words, start, stop
    best, above = empty, {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(i + diagonal - band, 0), min(i + diagonal + band + 1, len(text))):
            score, matched, start, _ = above.get(j - 1, empty)
            if text[j] == word:
                cell = (score + 2, matched + 1, start if score > 0 else j, j + 1)
            else:
                cell = (score - 1, matched, start, j + 1)
                for other in (above.get(j, empty), row.get(j - 1, empty)):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                if (cell[0], -cell[3]) > (best[0], -best[3]):
                    best = cell
        above = row
    return best[1], best[2], best[3]


def scan_words(index: TemplateIndex, words: list[bytes], percent: int, band: int) -> list[tuple[str, int, float, int, int]]:
    """Matches of one text: template, matched words, coverage, and the span in words.

    Of matches that overlap, the one with more matched words stays, then the one with the higher coverage.
    """
    codes = np.fromiter(map(index.vocab.get, words, repeat(0)), np.int64, len(words))
    found = []
    for template, hits in index.hits(codes).items():
        pattern = index.words[template].tolist()
        # Hits close to each other in the text and in their diagonal belong to one candidate.
        hits.sort()
        groups: list[list[tuple[int, int]]] = []
        for place, at in hits:
            for group in reversed(groups[-4:]):
                near = abs((place - at) - (group[-1][0] - group[-1][1])) <= band
                if near and place - group[0][0] <= len(pattern) + band:
                    group.append((place, at))
                    break
            else:
                groups.append([(place, at)])
        for group in groups:
            for matched, start, stop in _spans(pattern, codes, group, percent, band):
                found.append((index.names[template], matched, matched / len(pattern), start, stop))
    out: list[tuple[str, int, float, int, int]] = []
    starts: list[int] = []
    for match in sorted(found, key=lambda m: (-m[1], -m[2], m[3], m[0])):
        at = bisect_right(starts, match[3])
        if (not at or out[at - 1][4] <= match[3]) and (at == len(out) or match[4] <= out[at][3]):
            starts.insert(at, match[3])
            out.insert(at, match)
    return out


def _spans(pattern: list[int], codes: np.ndarray, hits: list[tuple[int, int]], percent: int, band: int):
    """Matched words, start and stop of all matches of one candidate: the best one, then those left and right of it."""
    pending = [(hits, 0, len(codes))]
    while pending:
        hits, low, high = pending.pop()
        if not hits:
            continue
        diagonals = sorted(place - at for place, at in hits)
        middle = diagonals[len(diagonals) // 2]
        first = max(middle - band, low)
        text = codes[first : max(min(middle + len(pattern) + band + 1, high), first)].tolist()
        matched, start, stop = align(pattern, text, middle - first, band)
        start, stop = first + start, first + stop
        if 100 * matched >= percent * len(pattern):
            yield matched, start, stop
            pending.append(([h for h in hits if h[0] < start], low, start))
            pending.append(([h for h in hits if h[0] >= stop], stop, high))
        elif diagonals[-1] - diagonals[0] > band:
            # The band around the middle does not hold all of them.
            pending.append(([h for h in hits if h[0] - h[1] < middle], low, high))
            pending.append(([h for h in hits if h[0] - h[1] > middle], low, high))


def _scan(batches: Iterator[pa.RecordBatch], index: TemplateIndex, percent: int, band: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()),
         ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64())]
    )
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            words = words_of(text)
            rows += [(doc_id, *m, len(words)) for m in scan_words(index, words, percent, band)]
        columns = zip(*rows) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = COVERAGE_PERCENT,
    band: int = BAND,
) -> DataFrame:
    """One row per match: ``doc_id, license, matched, coverage, first_word, end_word, n_words``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
    lower-cased. ``coverage`` is the share of the template's words that the alignment matched, at
    least ``percent`` of 100; the span is in words of the document, its end exclusive. A notice
    that occurs again is another match, also right after the first.

    A null or empty text and one without notices has no row. A null id is kept. Rows that repeat a
    document are scanned each. An empty table, or no templates, gives no rows. Short
    templates have shorter hashed runs, so that one with missing words is still found. Other columns are not read.
    """
    prepare(docs.sparkSession)
    index = TemplateIndex(TEMPLATES if templates is None else templates, percent=percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_scan, index=index, percent=percent, band=band),
        "doc_id long, license string, matched long, coverage double, first_word long, end_word long, n_words long",
    )
