"""Licence statements in documents: a paragraph classifier confirmed by template comparison.

A sparse multinomial logistic regression over word unigrams and bigrams assigns a
line, or a run of words of a paragraph, to a licence family or to ``unknown``. It is
trained on the driver from the families' templates, varied, and from a bounded
sample of the corpus' own paragraphs as ``unknown``; a temperature fitted on held
out examples calibrates its chances. A predicted family holds only if the
text shares enough word pairs with one of the family's templates.

Scoring reads every whole text in one pass. Lines come first, each by itself. Then
the lines between two blank ones are joined to a paragraph, and the runs of words
in it that hold enough of a template's word pairs are judged, the fullest first:
so notices wrapped over lines, behind comment marks or inside other text are found.
A run is at most ``STRETCH`` times as long as its template; what a line or a fuller
run has reported is not reported again. A title ("MIT License") counts only as a
whole line that the classifier gives to the title's family. A line or paragraph without a single word pair of the templates has no
evidence for any family; it is unknown without further work.

``paragraph`` is the number of the (first) line, ``statement`` the line, or the
text from the first to the last word of the run.

Cases: null and empty texts have no paragraph. Repeated rows give repeated
results. Ties between families go to the first in the alphabet.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.llm.common import picked, shared, small_batches, texts_of, tidy

# fixed values: usual wordings of licence notices
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020. All rights reserved.", "This document is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
}
# bodies of licence texts, known as word pairs; the classifier learns from them too
BODIES = {
    "agpl": [
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "public-domain": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
}
# whole lines only: in other text a licence's name states nothing
TITLES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, Version 3", "GNU AGPL"],
    "apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD License"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, Version 2", "GNU General Public License, Version 3", "GNU GPL"],
    "isc": ["ISC License", "The ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, Version 2.1", "GNU Lesser General Public License, Version 3", "GNU LGPL"],
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License Version 2.0"],
    "zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
}
UNKNOWN = "unknown"
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
LEAST_SHARED = 0.6
STRETCH = 1.25  # of a run of words, by the words of its template


def templates(family: str) -> list[str]:
    return TEMPLATES[family] + BODIES.get(family, [])


def taught(family: str) -> list[str]:
    """What the classifier learns a family from."""
    return templates(family) + TITLES.get(family, [])


def grams(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def pairs(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


@dataclass
class Model:
    families: list[str]
    column: dict[str, int]
    weight: np.ndarray  # n-grams, the share of unknown n-grams and a constant, by classes; the last class is unknown
    temperature: float
    templates: list[list[set[str]]]

    def row(self, text: str) -> tuple[np.ndarray, float]:
        own = grams(text)
        known = sorted({self.column[g] for g in own if g in self.column})
        missing = sum(g not in self.column for g in own) / max(len(own), 1)
        return np.array(known, np.int64), missing

    def logits(self, text: str) -> np.ndarray:
        known, missing = self.row(text)
        return self.weight[known].sum(0) / np.sqrt(max(len(known), 1)) + missing * self.weight[-2] + self.weight[-1]

    def chances(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        chance = np.exp(z - z.max())
        return chance / chance.sum()

    def predict(self, text: str) -> tuple[str, float, float]:
        """Family, its chance, and the share of word pairs in common with its closest template."""
        chance = self.chances(text)
        best = int(chance.argmax())
        if best == len(self.families):
            return UNKNOWN, float(chance[best]), 0.0
        own = pairs(text)
        return self.families[best], float(chance[best]), max(len(own & t) / len(t) for t in self.templates[best])


def fit(unknown: list[str], seed: int = 9, varied: int = 60, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Train on varied templates and on paragraphs that name no licence."""
    random = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    column = {g: i for i, g in enumerate(sorted({g for f in families for t in taught(f) for g in grams(t)}))}
    model = Model(families, column, np.zeros((len(column) + 2, len(families) + 1)), 1.0, [[pairs(t) for t in templates(f)] for f in families])
    texts, labels = [], []
    for i, family in enumerate(families):
        for template in taught(family):
            words = template.split()
            for n in range(varied):
                kept = [w for w in words if random.random() > 0.1] if n and len(words) > 6 else list(words)
                before = unknown[random.integers(len(unknown))].split()[: random.integers(6)] if unknown and n % 3 == 1 else []
                after = unknown[random.integers(len(unknown))].split()[: random.integers(12)] if unknown and n % 3 == 2 else []
                texts.append(" ".join([*before, *kept, *after]))
                labels.append(i)
    # single template words in other company are no licence
    loose = sorted({w for w in column if " " not in w})
    texts += unknown + [" ".join(random.choice(loose, 8)) for _ in range(300)]
    labels += [len(families)] * (len(texts) - len(labels))
    x = np.zeros((len(texts), len(column) + 2))
    for i, text in enumerate(texts):
        known, missing = model.row(text)
        x[i, known] = 1 / np.sqrt(max(len(known), 1))
        x[i, -2:] = missing, 1
    y = np.eye(len(families) + 1)[labels]
    order = random.permutation(len(texts))
    learn, hold = order[len(order) // 5 :], order[: len(order) // 5]
    share = 1 / y[learn].sum(0).clip(1)
    per_row = (y[learn] @ share)[:, None] / len(share)
    w, speed = model.weight, np.zeros_like(model.weight)
    for _ in range(steps):
        z = x[learn] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (x[learn].T @ (per_row * (p - y[learn])) + ridge * w / len(share))
        w += speed
    z = x[hold] @ w

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(y[hold] * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def sample_paragraphs(docs: DataFrame, most: int = 1500, longest: int = 2000) -> list[str]:
    """Last paragraphs of a bounded sample of rows, drawn by a hash, that hold no template's word pairs."""
    known = [pairs(t) for f in TEMPLATES for t in templates(f)]
    total = docs.count()
    rate = min(1.0, 2 * most / max(total, 1))
    rows = docs.where(F.col("text").isNotNull() & (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= int(rate * ((1 << 63) - 1024))))
    first = rows.select(F.substring(F.element_at(F.split("text", "\n"), -1), 1, longest).alias("p")).limit(2 * most).collect()
    return sorted(r["p"] for r in first if r["p"] and not any(len(pairs(r["p"]) & t) >= LEAST_SHARED * len(t) for t in known))[:most]


class Runs:
    """Finds runs of words that hold at least ``LEAST_SHARED`` of a template's distinct word pairs."""

    def __init__(self):
        self.sizes: list[tuple[int, int]] = []  # pairs a template has, words a run of it may have
        self.holders: dict[str, dict[str, list[int]]] = {}  # first word, second word: the templates
        for text in (t for f in sorted(TEMPLATES) for t in templates(f)):
            own = pairs(text)
            for pair in own:
                a, b = pair.split(" ")
                self.holders.setdefault(a, {}).setdefault(b, []).append(len(self.sizes))
            self.sizes.append((len(own), int(STRETCH * len(WORD.findall(text.lower()))) + 1))

    def hits(self, words: list[str]) -> list[tuple[int, list[int]]]:
        """Positions of word pairs that templates hold, and which."""
        get = self.holders.get
        return [(i, held) for i, a in enumerate(words[:-1]) if (after := get(a)) and (held := after.get(words[i + 1]))]

    def of(self, words: list[str], hits: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
        """First and last word of every such run, the fullest first; a run starts and ends with a pair of the template."""
        by_template: dict[int, list[int]] = {}
        for i, held in hits:
            for t in held:
                by_template.setdefault(t, []).append(i)
        found = []
        for t, at in by_template.items():
            size, longest = self.sizes[t]
            if len(at) < LEAST_SHARED * size:
                continue
            counts: dict[tuple[str, str], int] = {}
            left = 0
            for i in at:
                pair = words[i], words[i + 1]
                counts[pair] = counts.get(pair, 0) + 1
                # too long, or the first pair comes again later
                while i + 2 - at[left] > longest or counts[words[at[left]], words[at[left] + 1]] > 1:
                    first = words[at[left]], words[at[left] + 1]
                    counts[first] -= 1
                    if not counts[first]:
                        del counts[first]
                    left += 1
                if len(counts) >= LEAST_SHARED * size:
                    found.append((-len(counts) / size, -len(counts), at[left], i + 1))
        return [(a, b) for _, _, a, b in sorted(found)]


def statements(whole: str, model: Model, runs: Runs, titles: dict[tuple[str, ...], str]):
    """Line number, family, score, similarity and statement of all finds in a text, in order."""
    lines = whole.split("\n")
    words_of = [WORD.findall(line.lower()) for line in lines]
    out = []

    def spot(n: int, k: int) -> tuple[int, int]:
        """Where the word k of line n stands in it."""
        spans = [m.span() for m in WORD.finditer(lines[n])]
        # lower case splits a few words
        return spans[k] if len(spans) == len(words_of[n]) else (0, len(lines[n]))

    def paragraph(begin: int, end: int):
        words = [w for n in range(begin, end) for w in words_of[n]]
        named = [n for n in range(begin, end) if tuple(words_of[n]) in titles]
        hits = runs.hits(words)
        if not hits and not named:
            return
        starts = [0]
        for n in range(begin, end):
            starts.append(starts[-1] + len(words_of[n]))
        taken = bytearray(len(words))
        at = [i for i, _ in hits]
        for n in range(begin, end):
            lo, hi = starts[n - begin], starts[n - begin + 1]
            first = bisect_left(at, lo)
            if first == len(at) or at[first] + 1 >= hi:  # no pair inside the line
                continue
            family, score, similarity = model.predict(lines[n])
            if family != UNKNOWN and similarity >= LEAST_SHARED:
                out.append((n, family, score, similarity, lines[n]))
                taken[lo:hi] = b"\1" * (hi - lo)
        for a, b in runs.of(words, hits):
            if any(taken[a : b + 1]):
                continue
            family, score, similarity = model.predict(" ".join(words[a : b + 1]))
            if family == UNKNOWN or similarity < LEAST_SHARED:
                continue
            taken[a : b + 1] = b"\1" * (b + 1 - a)
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, b) - 1
            text = "\n".join(lines[begin + i : begin + j + 1])
            left, right = spot(begin + i, a - starts[i])[0], len(lines[begin + j]) - spot(begin + j, b - starts[j])[1]
            out.append((begin + i, family, score, similarity, text[left : len(text) - right]))
        for n in named:
            if not any(taken[starts[n - begin] : starts[n - begin + 1]]):
                family, score, _ = model.predict(lines[n])
                if family == titles[tuple(words_of[n])]:  # the comparison with whole titles confirms the classifier
                    out.append((n, family, score, 1.0, lines[n]))

    begin = 0
    for n in range(len(lines) + 1):
        if n == len(lines) or not words_of[n]:
            if n > begin:
                paragraph(begin, n)
            begin = n + 1
    return sorted(out, key=lambda r: r[0])


def scan(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each paragraph that names a licence: doc_id, paragraph, family, score, similarity, statement."""
    docs = picked(df, doc_id=doc_id, text=text)
    small_batches(df.sparkSession)
    load = shared(df.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scanned(batches):
        model = load()
        runs, titles = Runs(), {tuple(WORD.findall(t.lower())): f for f, names in TITLES.items() for t in names}
        for batch in batches:
            rows = {"at": [], "paragraph": [], "family": [], "score": [], "similarity": [], "statement": []}
            for i, whole in enumerate(texts_of(batch.column("text"))):
                for found in statements(whole, model, runs, titles):
                    for key, value in zip(rows, (i, *found), strict=True):
                        rows[key].append(value)
            at = rows.pop("at")
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())
            columns = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", *rows])

    return docs.mapInArrow(tidy(scanned), f"doc_id {kind}, paragraph int, family string, score double, similarity double, statement string")
