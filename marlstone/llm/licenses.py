"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters and digits in lower case; a template is the set of its
five-word shingles. For each template length m the text is cut into windows of m
shingles every m/8; windows without any template shingle cannot match and are
passed over. The others' MinHash signatures (``bands`` bands of ``rows`` values)
are looked up in the templates' band table. Each template retrieved is verified:
the share of its shingles that the window, widened by a quarter on both sides,
really holds must reach ``min_containment``.

A text that holds a share c of a template in place meets some window with a
Jaccard similarity of at least about (15/16 c) / (2 - 15/16 c); with 32 bands of
2 values it is missed with probability (1 - J^2)^32: below 1e-6 at c = 0.8 and
1e-20 at c = 1 (``miss_probability``).

One pass without a shuffle; the templates are a fixed list, so what tasks hold
does not grow. Defined cases: null, empty and short texts match nothing. All
verified places count: the fullest stand, and one that a fuller place which stands
overlaps is dropped; equals may overlap. Of each template the fullest place left is
reported, the first of equals. Rows given twice are
reported twice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS, MIN_CONTAINMENT, STEPS = 5, 32, 2, 0.8, 8
_WORDS = re.compile(r"[^\W_]+")

# License notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License",
    "mit-notice-3": "Licensed under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
}


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """A hash for each run of SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    return out ^ (out >> np.uint64(31))


def miss_probability(containment: float, bands: int = BANDS, rows: int = ROWS) -> float:
    held = containment * (1 - 1 / (2 * STEPS))
    return (1 - (held / (2 - held)) ** rows) ** bands


class Scanner:
    """The templates' shingles and band table."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS, min_containment: float = MIN_CONTAINMENT) -> None:
        self.bands, self.rows, self.least = bands, rows, min_containment
        rng = np.random.default_rng(23)
        self.mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.sets = {name: np.unique(shingle_hashes(words_of(text))) for name, text in templates.items()}
        self.sets = {name: s for name, s in self.sets.items() if len(s)}
        self.vocabulary = {w: 1 for text in templates.values() for w in words_of(text)}
        self.table: dict[tuple[int, int], list[str]] = defaultdict(list)
        self.of_shingle: dict[int, list[str]] = defaultdict(list)
        for name, s in self.sets.items():
            for key in self.keys(s):
                self.table[key].append(name)
            for x in s.tolist():
                self.of_shingle[x].append(name)
        self.every = np.array(sorted(self.of_shingle), np.uint64)

    def keys(self, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
        """(band, key) of a set's MinHash signature."""
        h = shingles[:, None] * self.mult
        least = (h ^ (h >> np.uint64(32))).min(0).reshape(self.bands, self.rows)
        keys = least[:, 0].copy()
        for k in range(1, self.rows):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k]
        return enumerate(keys.tolist())

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, last word) of each template found."""
        words = words_of(text)
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int8, len(words))
        run = np.r_[0, np.cumsum(known, dtype=np.int64)]
        whole = np.flatnonzero(run[SHINGLE:] - run[:-SHINGLE] == SHINGLE) if len(words) >= SHINGLE else []
        if not len(whole):
            return []
        # Only the surroundings of template words are hashed.
        longest = max(map(len, self.sets.values()))
        places: set[tuple[float, int, int, str]] = set()
        splits = np.flatnonzero(np.diff(whole) > 4 * longest) + 1
        for part in np.split(whole, splits):
            lo, hi = max(0, int(part[0]) - 2 * longest), min(len(words), int(part[-1]) + 2 * longest + SHINGLE)
            self._scan_part(shingle_hashes(words[lo:hi]), lo, places)
        return standing(places)

    def _scan_part(self, h: np.ndarray, base: int, places: set[tuple[float, int, int, str]]) -> None:
        anchors = np.flatnonzero(np.isin(h, self.every))
        lengths = {len(self.sets[name]) for x in h[anchors].tolist() for name in self.of_shingle[x]}
        for m in sorted(lengths):
            step = max(1, m // STEPS)
            first = np.maximum(0, anchors - m + 1) // step
            starts = {int(s) * step for a, b in zip(first, anchors // step) for s in range(a, b + 1)}
            for start in sorted(starts):
                got = {name for key in self.keys(h[start : start + m]) for name in self.table.get(key, ()) if len(self.sets[name]) == m}
                wide = max(0, start - m // 4), start + m + m // 4
                for name in got:
                    s = self.sets[name]
                    held = np.flatnonzero(np.isin(h[wide[0] : wide[1]], s))
                    share = len(np.unique(h[wide[0] : wide[1]][held])) / len(s)
                    if share >= self.least:
                        at = base + wide[0]
                        places.add((share, at + int(held[0]), at + int(held[-1]) + SHINGLE - 1, name))


def standing(places: set[tuple[float, int, int, str]]) -> list[tuple[str, float, int, int]]:
    """(license, share, first, last) of the fullest place left of each template, when places that fuller ones overlap are gone.

    Versions of one notice share most shingles; where two overlap in place, the fuller match stands.
    """
    best: dict[str, tuple[float, int, int]] = {}
    taken: list[tuple[int, int]] = []  # places that stand, joined and in order
    for share, group in groupby(sorted(places, key=lambda p: (-p[0], *p[1:])), key=lambda p: p[0]):
        begins = [a for a, _ in taken]
        free = []
        for _, a, b, name in group:
            k = bisect_right(begins, b) - 1  # the last taken place that begins at or before the end
            if k < 0 or taken[k][1] < a:
                free.append((a, b))
                best.setdefault(name, (share, a, b))
        joined: list[tuple[int, int]] = []
        for a, b in sorted(taken + free):
            if joined and a <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(joined[-1][1], b)
            else:
                joined.append((a, b))
        taken = joined
    return [(name, *found) for name, found in sorted(best.items())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, bands: int = BANDS, rows: int = ROWS, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, containment, first_word, last_word): a row for each template in a document."""
    known = TEMPLATES if templates is None else templates

    def scan(batches):
        scanner = Scanner(known, bands, rows, min_containment)
        for pdf in batches:
            found = [(i, *x) for i, t in zip(pdf["id"], pdf["text"]) for x in scanner.scan(t)]
            yield pd.DataFrame(found, columns=["doc_id", "license_id", "containment", "first_word", "last_word"])

    # Ids travel as text, for a null id must not turn longs into floats.
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = narrow.mapInPandas(scan, "doc_id string, license_id string, containment double, first_word long, last_word long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
