"""License notices: exact phrases, and a set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, hash_word, rows_of, small_batches

# The phrases and labels that any scan reports.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as they stand in files and on pages, by label. Words are compared as sets.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"],
    "mit-notice": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "bsd-conditions": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "apache-notice": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"],
    "gpl-notice": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
}
#: A run of lines is a block of a template if it has no more words than this many times the template's distinct ones.
SPREAD = 2
SCHEMA = "{id} {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, list[int]]]:
    """(label, hashes of its distinct words) of each template."""
    return [(label, sorted({int(h) for h in Words([t]).hashes})) for label, texts in templates.items() for t in texts]


def _counts(vocabulary: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for (texts,) in rows_of(batches, "text"):
            for a, b in by_bytes(texts):
                h = Words(texts[a:b]).hashes
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"token": np.arange(len(vocabulary)), "n": total})

    return run


class Index:
    """Templates with their words in ascending order of corpus frequency."""

    def __init__(self, sets: list[tuple[str, list[int]]], frequency: dict[int, int], threshold: float):
        self.labels = [label for label, _ in sets]
        self.words = [sorted(s, key=lambda h: (frequency.get(h, 0), h)) for _, s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.words]
        self.vocabulary = np.array(sorted({h for s in self.words for h in s}), dtype=np.uint64)
        self.rank = {h: (frequency.get(h, 0), h) for s in self.words for h in s}
        #: By word: (template, place) for the words of which a line that meets the threshold must have one.
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.words):
            for place, h in enumerate(s[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(h, []).append((t, place))
        self.prefixes = np.array(sorted(self.prefix), dtype=np.uint64)

    def share(self, t: int, words: set[int]) -> float:
        """The part of template t's words that are among words, 0 if it is under the threshold."""
        common = sum(x in words for x in self.words[t])
        return common / len(self.words[t]) if common >= self.need[t] else 0.0

    def match(self, line: set[int], known: list[int]) -> dict[int, float]:
        """known: the line's words that are in the vocabulary, in the global order. Gives containment by template."""
        out: dict[int, float] = {}
        seen: set[int] = set()
        for place, h in enumerate(known):
            for t, at in self.prefix.get(h, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first common word: no earlier word of the template is in the line
                need = self.need[t]
                if len(line) < need or min(len(self.words[t]) - at, len(known) - place) < need:
                    continue
                common = sum(x in line for x in self.words[t][at:])
                if common >= need:
                    out[t] = common / len(self.words[t])
        return out


def runs_around(x: int, number: np.ndarray, start: np.ndarray, of: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """For each start the longest run (from, to) of two and more lines that follow each other, holds line x and has at most `most` words."""
    follows = lambda i: i + 1 < len(number) and number[i + 1] == number[i] + 1 and of[i + 1] == of[i]
    lo = x
    while start[x + 1] - start[lo] <= most:
        hi = x
        while follows(hi) and start[hi + 2] - start[lo] <= most:
            hi += 1
        if hi > lo:
            yield lo, hi
        if not lo or not follows(lo - 1):
            return
        lo -= 1


def _scan(index: Index, phrases: dict[str, str], schema: pa.Schema):
    wanted = [(np.array([hash_word(w) for w in p.split()], dtype=np.uint64), label, p.encode().split()) for p, label in phrases.items()]

    def one(ids: list, texts: list) -> pa.RecordBatch:
        w = Words(texts)
        h, n = w.hashes, np.diff(w.first)
        doc = np.repeat(np.arange(len(texts)), n)
        n_base, first, last = [0] * len(texts), [None] * len(texts), [None] * len(texts)
        base: list[set] = [set() for _ in texts]
        own: list[set] = [set() for _ in texts]
        score = [0.0] * len(texts)
        for hashes, label, exact in wanted:
            m = len(hashes)
            if len(h) < m:
                continue
            hit = h[: len(h) - m + 1] == hashes[0]
            for j in range(1, m):
                hit &= h[j : len(h) - m + 1 + j] == hashes[j]
            for i in np.flatnonzero(hit & (doc[: len(h) - m + 1] == doc[m - 1 :])):
                if all(w.word(i + j) == x for j, x in enumerate(exact)):
                    d, at = doc[i], int(i - w.first[doc[i]])
                    n_base[d] += 1
                    first[d] = at if first[d] is None else min(first[d], at)
                    last[d] = at if last[d] is None else max(last[d], at)
                    base[d].add(label)
                    score[d] = 1.0
        if len(h) and len(index.prefixes):
            breaks = np.flatnonzero((w.buf == 10) | (w.buf == 0))
            number, start = np.unique(np.searchsorted(breaks, w.start), return_index=True)  # lines with words
            of, start = doc[start], np.append(start, len(h))
            at = np.minimum(np.searchsorted(index.prefixes, h), len(index.prefixes) - 1)
            for x in np.unique(np.searchsorted(start, np.flatnonzero(index.prefixes[at] == h), "right") - 1).tolist():
                a, b, d = start[x], start[x + 1], of[x]
                words = set(h[a:b].tolist())
                known = sorted((v for v in words if v in index.rank), key=index.rank.__getitem__)
                found = index.match(words, known)
                for t in {t for v in known for t, _ in index.prefix.get(v, ())}:
                    for lo, hi in runs_around(x, number, start, of, SPREAD * len(index.words[t])):
                        found[t] = max(found.get(t, 0.0), index.share(t, set(h[start[lo] : start[hi + 1]].tolist())))
                for t, c in found.items():
                    if c > 0:
                        own[d].add(index.labels[t])
                        score[d] = max(score[d], c)
        join = lambda s: ",".join(sorted(s))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, n.tolist(), n_base, first, last, [join(s) for s in base], [join(s | o) for s, o in zip(base, own)], score], schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "id", "text"):
            for a, b in by_bytes(texts):
                yield one(ids[a:b], texts[a:b])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels each text with the phrases it holds and the templates that a block of it meets.

    A block is a line, or, for notices that are wrapped over lines, a run of lines that follow each other without a line that has no words, with
    at most SPREAD times as many words as the template has distinct ones (longer runs would hold a template's words by chance). Marks of
    comments aren't words. A block meets a template if it holds at least threshold of the template's distinct
    words. Two passes: the first counts the templates' words over all texts (a total
    for each word of the templates, so its size has a bound); the second orders words by these
    counts, rarest first, and compares a line with a template only if they share a
    word of the template's prefix (prefix filter), the line has enough words (length
    filter), and enough words are left after the first common one (positional filter). A run is compared if one of its lines has a word of the prefix,
    and only the longest run from each line, for it holds what shorter ones hold.
    The filters lose nothing, so every block that meets the threshold is found.

    Returns id, n_words, n_base (all places of phrases), first_word, last_word,
    base_labels, labels, score (largest containment found; 1 with a phrase; else 0). Null
    and empty texts have no words, no labels, null places and score 0. Repeated rows
    each get a row; ids may be null. Other columns are ignored. An empty table gives no rows.
    """
    src = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = template_sets(templates)
    vocabulary = np.array(sorted({h for _, s in sets for h in s}), dtype=np.uint64)
    frequency: dict[int, int] = {}
    if len(vocabulary):
        counted = src.select("text").mapInArrow(_counts(vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
        frequency = {int(vocabulary[r.token]): r.n for r in counted}
    id_type = src.schema["id"].dataType
    out = src.mapInArrow(_scan(Index(sets, frequency, threshold), phrases, _arrow_schema(id_type)), SCHEMA.format(id="id", id_type=id_type.simpleString()))
    return out.withColumnRenamed("id", id_col)


def _arrow_schema(id_type) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("id", to_arrow_type(id_type)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
