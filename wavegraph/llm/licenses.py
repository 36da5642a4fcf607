"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies them.

Texts and templates are sequences of words (letters and digits, A to Z folded), and their shingles of
five words. Templates come in classes of like length. For each class a text is cut into overlapping
windows, long enough and close enough that an occurrence of a template lies whole in some window. A
window's signature is the least value of its shingles under each of the class's hash functions; a
template with the same least value under one of them is retrieved, and verified by the share of its
shingles that the window holds, which must be ``CONTAINED`` or more.

The number of hash functions of a class follows from the least Jaccard similarity that a window with
a sufficient share of a template has to it: so many that such a window is missed with a probability
of at most ``MISS``.

Scale: one pass over the texts, no shuffle. The templates are a list that is sent to all executors;
their number is that of known licenses. Only windows with at least one shingle of some template are
hashed, as others have no least value in common with any.

Defined cases: a null text has no words; templates of fewer words than a shingle are refused; repeated
and empty rows are scanned one by one; the other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.common import batched, mix, raw, slices, split_words, table, windows, word_hashes

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
CLASS_RATIO = 1.5
OVERLAP = 8

# Notices by which the licenses are commonly declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "All rights reserved. No part of this work may be reproduced without written permission."),
)

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a slice of texts: hash, row, and number of the first word in its text; and each text's words."""
    data, first, end, row = split_words(texts, _WORD_BYTES, lower=True)
    hash, place = windows(word_hashes(data, first, end), row, size)
    count = np.bincount(row, minlength=len(texts))
    return hash, row[place], place - (np.cumsum(count) - count)[row[place]], count


@dataclass
class TemplateClass:
    """Templates of like length, the windows that suit them, and their least values under each hash function."""

    window: int
    step: int
    salts: np.ndarray
    members: list[int]
    least: np.ndarray  # [member, function]


class Index:
    """Templates by MinHash bands of one row each."""

    def __init__(self, templates: tuple[tuple[str, str], ...], contained: float = CONTAINED, miss: float = MISS) -> None:
        self.names = [name for name, _ in templates]
        self.contained = contained
        hash, row, _, _ = shingles(pa.array([text.encode() for _, text in templates], pa.binary()))
        self.sets = [np.unique(hash[row == k]) for k in range(len(templates))]
        if not all(map(len, self.sets)):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.any = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.classes: list[TemplateClass] = []
        left = sorted(range(len(templates)), key=lambda k: len(self.sets[k]))
        rng = np.random.default_rng(17)
        while left:
            shortest = len(self.sets[left[0]])
            members = [k for k in left if len(self.sets[k]) <= CLASS_RATIO * shortest]
            left = left[len(members) :]
            longest = len(self.sets[members[-1]])
            step = max(1, longest // OVERLAP)
            window = longest + step - 1
            # The share ``contained`` of a template in a window, which holds nothing else of it.
            alike = min(contained * len(self.sets[k]) / (window + (1 - contained) * len(self.sets[k])) for k in members)
            count = max(1, math.ceil(math.log(miss) / math.log(1 - alike))) if alike < 1 else 1
            salts = rng.integers(1, 1 << 63, count, dtype=np.uint64)
            least = np.array([[mix(self.sets[k] ^ s).min() for s in salts] for k in members], np.uint64)
            self.classes.append(TemplateClass(window, step, salts, members, least))

    def scan(self, hash: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share) of the matches in one text, each where most of the template is."""
        hit = np.isin(hash, self.any)
        near = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, list[tuple[int, int, float]]] = {}
        for kind in self.classes:
            starts = np.arange(0, max(1, len(hash) - kind.window + kind.step), kind.step)
            stops = np.minimum(starts + kind.window, len(hash))
            some = near[stops] > near[starts]
            starts, stops = starts[some], stops[some]
            for a in range(0, len(starts), 4096):
                at = starts[a : a + 4096, None] + np.arange(kind.window)[None, :]
                inside = at < stops[a : a + 4096, None]
                values = hash[np.minimum(at, len(hash) - 1)]
                found = np.zeros((len(at), len(kind.members)), bool)
                for j, salt in enumerate(kind.salts):
                    lowest = np.where(inside, mix(values ^ salt), np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
                    found |= lowest[:, None] == kind.least[None, :, j]
                for w, m in zip(*np.nonzero(found)):
                    template = kind.members[m]
                    span = slice(int(starts[a + w]), int(stops[a + w]))
                    mine = np.flatnonzero(np.isin(hash[span], self.sets[template])) + span.start
                    share = len(np.unique(hash[mine])) / len(self.sets[template])
                    if share >= self.contained:
                        best.setdefault(template, []).append((int(place[mine[0]]), int(place[mine[-1]]) + SHINGLE, share))
        out = []
        for template, spans in best.items():
            # Of windows that overlap, the one with most of the template, then the shortest.
            taken: list[tuple[int, int, float]] = []
            for start, end, share in sorted(spans, key=lambda s: (-s[2], s[1] - s[0], s[0])):
                if all(end <= s or e <= start for s, e, _ in taken):
                    taken.append((start, end, share))
            out += [(template, *t) for t in taken]
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with ``matches``: license, first word and end of the place, share of the template; in the order of the text."""
    base = [c for c in docs.columns if c != "matches"]
    kept = docs.select(*(docs[c] for c in base))
    at = base.index(text)
    kind = "array<struct<license:string,start:bigint,end:bigint,share:double>>"
    schema = kept.withColumn("matches", F.lit(None).cast(kind)).schema
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = raw(batch.column(at)).fill_null(b"")
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            for start, stop in slices(texts):
                hash, row, place, _ = shingles(texts.slice(start, stop - start))
                for k in np.unique(row[np.isin(hash, index.any)]).tolist():
                    part = slice(*np.searchsorted(row, [k, k + 1]))
                    found[start + k] = [
                        {"license": index.names[m], "start": s, "end": e, "share": share}
                        for m, s, e, share in index.scan(hash[part], place[part])
                    ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _MATCH)], names=[f.name for f in schema])

    return batched(kept).mapInArrow(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(places, ",").alias("places"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("best_share"),
    )
