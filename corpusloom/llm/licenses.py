"""License scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines, and runs of neighbouring lines that make up one wrapped sentence or
notice: a run ends at a blank line or at a line that ends a sentence, and a run of more
than RUN lines is taken in pieces of RUN lines that overlap by half. Comment marks
don't count, as only words do. A paragraph becomes indicators of hashed word unigrams and
bigrams; a multinomial logistic regression with one class a licence family and one for
unknown gives probabilities. The training set is made from the templates below (with
names, comment marks, dropped words and joined notices) and, for unknown, from near-miss
sentences and at most MOST_OTHER distinct lines of the corpus, half of them lines that name
words of licences without having a template's wording (two bounded samples, picked by hash
among the lines of 20 to 400 letters; of the plain lines one in 64, by hash, is looked at). Probabilities are calibrated by a temperature that
is fit across three folds, each of which holds out whole templates and lines, not copies.
A prediction stands if the probability of unknown is at most 1 - LEAST and the closest
template of one of the three likeliest families confirms it: the weighted share of the
template's words and word pairs that the paragraph has is at least SHARED. Of confirmed families
that with the largest product of probability and share is named; `probability` is that of a
licence. A run is reported if none of its lines is.

Every paragraph of every whole text is scored, in one pass without a shuffle, a batch of
texts at a time. start and stop are bytes of the UTF-8 text; paragraph is the number of the
first line, lines without a word counted too.

Defined cases: null, empty or wordless texts have no paragraphs and so no rows; null
ids keep their rows; repeated rows are scanned each; without documents the model is
trained on the templates and near misses alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, spread
from .labelled import Tokens, batches_of, grams, least_hashed, sums

BITS = 16
RUN = 16
LEAST, SHARED = 0.5, 0.6
MOST_OTHER = 1500
#: Licence families and the wording of their notices.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "This project is distributed under the terms of the MIT License (MIT).",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU GPL v2.",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright 2021 Example Inc. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying is strictly prohibited."],
}
NEAR_MISSES = [
    "He renewed his driver license in version 3 of the form.", "The license plate was reserved.", "Public transport is free of charge in the city.", "A license to operate the ferry was granted by the general council.",
    "The software was released in May.", "Copyright is a branch of law.", "The foundation published its free report.", "Creative people in common work by hand.", "The Apache helicopter was modified.",
    "She works at MIT on software.", "Permission to land was granted.", "This work is under way.", "All seats are reserved.", "The terms of the public were met.", "Distribution of food in source regions.",
]
FAMILIES = ["unknown", *TEMPLATES]
def features(paragraphs: list[str]) -> list[np.ndarray]:
    """The features of each paragraph."""
    t = Tokens([p.encode() for p in paragraphs], None)
    of, found = grams(t.h, t.text, BITS, repeats=False)
    return np.split(found, np.searchsorted(of, np.arange(1, len(paragraphs))))


def examples(other: list[str], seed: int = 5) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Training paragraphs made from the templates, and unknown ones; their classes; and their folds, one for all that is made of a template or line."""
    rng = np.random.default_rng(seed)
    names = ["Ann Lee", "Example Inc", "the project authors", "Contributors", "J. Doe 2019", "(c) 2020"]
    rows, y, fold = [], [], []
    for k, texts in enumerate(TEMPLATES.values(), 1):
        for n in range(120):
            words = texts[n % len(texts)].split()
            if len(words) > 6 and n >= len(texts):
                words = [w for w in words if rng.random() > 0.08]
            before = ["", "# ", "// ", "* ", names[n % 6] + " ", "Copyright " + names[n % 6] + ". "][n % 6]
            after = "" if n % 3 else " " + names[(n // 3) % 6]
            if other and n % 4 == 3:
                after += " " + " ".join(other[int(rng.integers(len(other)))].split()[:12])
            rows.append(before + " ".join(words) + after)
            y.append(k)
            fold.append((k + n % len(texts)) % 3)
    for n, t in enumerate([*NEAR_MISSES, *other]):
        rows.append(t)
        y.append(0)
        fold.append(n % 3)
    return features(rows), np.array(y), np.array(fold)


class LicenseModel:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, rarity: dict[int, float]):
        self.weights, self.bias, self.temperature = weights.astype(np.float32), bias, temperature
        self.rarity = rarity
        self.templates = [[]] + [features(texts) for texts in TEMPLATES.values()]

    def logits(self, of: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bags that have features, and their rows of logits."""
        bags, total, n = sums(self.weights, of, feature)
        return bags, (total / np.sqrt(n)[:, None] + self.bias) / self.temperature

    def similarity(self, x: np.ndarray, family: int) -> float:
        """The largest weighted share of a template of the family that x has; rare features weigh more."""
        best = 0.0
        for t in self.templates[family]:
            w = np.array([self.rarity.get(int(f), 1.0) for f in t])
            best = max(best, float(w[np.isin(t, x)].sum() / w.sum()))
        return best

    def confirmed(self, h: np.ndarray, of: np.ndarray) -> dict[int, tuple[str, float, float]]:
        """Family, probability and similarity of the bags of words that are licence paragraphs. h, of: each word's hash and bag, in order."""
        bag, feature = grams(h, of, BITS, repeats=False)
        bags, z = self.logits(bag, feature)
        out = {}
        for lo in range(0, len(bags), 8192):
            p = softmax(z[lo : lo + 8192])
            for k in np.flatnonzero(p[:, 0] <= 1 - LEAST).tolist():
                b = bags[lo + k]
                x = feature[np.searchsorted(bag, b) : np.searchsorted(bag, b, "right")]
                likely = p[k, 1:].argsort()[::-1][:3] + 1
                near = [(float(p[k, f]) * s, int(f), s) for f in likely if (s := self.similarity(x, int(f))) >= SHARED]
                if near:
                    _, family, s = max(near)
                    out[int(b)] = (FAMILIES[family], float(1 - p[k, 0]), s)
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, str, float, float]]:
        """Text, line number, start, end, family, probability and similarity of the confirmed paragraphs."""
        t = Tokens(texts, None)
        line, stop = t.parts(b"\r\n")
        if not len(line):
            return []
        begin = np.append(-1, stop)[: len(stop)] + 1
        raw = np.frombuffer(t.buffer, np.uint8)
        known, first, n_words = np.unique(line, return_index=True, return_counts=True)  # the lines with words
        text = t.text[first]
        last_byte = raw[np.minimum(stop[known], len(raw)) - 1]
        width = np.array([len(x) for x in (t.buffer[a:b].strip() for a, b in zip(begin[known[1:] - 1], stop[known[1:] - 1], strict=True))]) if len(known) > 1 else np.zeros(0, np.int64)
        ends = np.isin(last_byte, np.frombuffer(b".!?", np.uint8))
        # a run goes on unless the line before ended a sentence, a blank line lies between, or the text is another
        apart = (text[1:] != text[:-1]) | ends[:-1] | (known[1:] - known[:-1] > 1) & (width == 0)
        run = np.cumsum(np.append(0, apart))
        place = np.arange(len(known)) - np.searchsorted(run, run)
        hits = {(int(k), int(k)): v for k, v in self.confirmed(t.h, np.repeat(np.arange(len(known)), n_words)).items()}
        lines_hit = np.zeros(len(known), bool)
        lines_hit[[k for k, _ in hits]] = True
        for shift in (0, RUN // 2):
            piece = (place + shift) // RUN
            new = np.append(True, (run[1:] != run[:-1]) | (piece[1:] != piece[:-1]))
            bag = np.cumsum(new) - 1
            a, size = np.flatnonzero(new), np.bincount(bag)
            whole = (size > 1) & (np.add.reduceat(lines_hit, a) == 0)
            if shift:  # the same piece was seen without the shift
                whole &= np.maximum.reduceat(place, a) >= RUN // 2
            pick = np.repeat(whole[bag], n_words)
            words = np.repeat(bag, n_words)[pick]
            for k, v in self.confirmed(t.h[pick], words).items():
                hits[int(a[k]), int(a[k] + size[k] - 1)] = v
        out, taken = [], set()
        for (a, b), v in sorted(hits.items()):
            if taken.isdisjoint(range(a, b + 1)):  # of overlapping pieces the first
                taken.update(range(a, b + 1))
                k = text[a]
                number = known[a] - np.searchsorted(stop, t.start[k])
                out.append((int(k), int(number), int(begin[known[a]] - t.start[k]), int(stop[known[b]] - t.start[k]), *v))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(other: list[str], steps: int = 100, decay: float = 1e-4) -> LicenseModel:
    rows, y, fold = examples(other)
    used = np.unique(np.concatenate(rows))
    count = Counter(int(f) for x in rows for f in x)
    rows_with = np.array([len(x) > 0 for x in rows])

    def train(pick):
        x = [rows[i] for i in pick]
        col = np.searchsorted(used, np.concatenate(x))
        row = np.repeat(np.arange(len(x)), [len(v) for v in x])
        value = np.repeat([len(v) ** -0.5 for v in x], [len(v) for v in x])
        starts = np.cumsum([0, *(len(v) for v in x[:-1])])
        w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
        sq, sqb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        order = np.argsort(col, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(col[order]) > 0))
        for _ in range(steps):
            p = softmax(np.add.reduceat(w[col] * value[:, None], starts, axis=0) + b)
            p[np.arange(len(x)), y[pick]] -= 1
            g = decay * w
            g[col[order][first]] += np.add.reduceat((p[row] * value[:, None])[order], first, axis=0) / len(x)
            sq += g * g
            gb = p.mean(0)
            sqb += gb * gb
            w -= 0.5 * g / np.sqrt(sq)
            b -= 0.5 * gb / np.sqrt(sqb)
        full = np.zeros((1 << BITS, len(FAMILIES)))
        full[used] = w
        return full, b

    z, picked = [], []
    for k in range(3):  # templates and lines that the fit hasn't seen
        pick = np.flatnonzero((fold == k) & rows_with)
        model = LicenseModel(*train(np.flatnonzero((fold != k) & rows_with)), 1.0, {})
        z.append(model.logits(np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick]), np.concatenate([rows[i] for i in pick]))[1])
        picked.append(pick)
    z, picked = np.concatenate(z), np.concatenate(picked)
    known = y[picked] > 0  # what is calibrated: whether a paragraph is a licence
    heat = np.geomspace(0.25, 8, 60)
    p = [1 - softmax(z / t)[:, 0] for t in heat]
    loss = [-np.log(np.where(known, x, 1 - x) + 1e-12).mean() for x in p]
    w, b = train(np.flatnonzero(rows_with))
    rarity = {f: float(np.log(1 + len(rows) / n)) for f, n in count.items()}
    return LicenseModel(w, b, float(heat[int(np.argmin(loss))]), rarity)


NAMING = "licen[sc]e|copyright|gpl|public domain|rights reserved|permission|redistribut|open source"


def other_paragraphs(docs: DataFrame, most: int = MOST_OTHER) -> list[str]:
    """At most `most` distinct corpus lines of 20 to 400 letters, half of them, at most, lines that name words of licences but have under half of any template: bounded samples picked by hash."""
    line = F.explode(F.split(F.col("text").cast("string"), "[\r\n]+")).alias("line")
    rows = docs.select(line).filter(F.length("line").between(20, 400))
    naming = F.lower("line").rlike(NAMING)
    plain = rows.filter(~naming).filter("xxhash64(line) % 64 = 0").distinct()  # a line that very many documents share counts once
    found = sorted(r[0] for r in least_hashed(cut(plain), F.xxhash64("line", F.lit(1)), "line", most // 2).collect())
    named = sorted(r[0] for r in least_hashed(cut(rows.filter(naming).distinct()), F.xxhash64("line", F.lit(1)), "line", most // 2).collect())
    templates = [x for texts in TEMPLATES.values() for x in features(texts)]
    shared = [max(np.isin(t, x).mean() for t in templates) for x in features(named)] if named else []
    return found + [t for t, s in zip(named, shared, strict=True) if s < 0.5]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, start, stop, family, probability, similarity of every confirmed licence paragraph."""
    model = fit(other_paragraphs(docs.select(F.col(text_col).alias("text"))))

    def fn(ids, texts):
        found = [(ids[lo + k], *x) for lo, part in batches_of(texts) for k, *x in model.scan(part)]
        cols = list(zip(*found, strict=True)) or [()] * 7
        return dict(zip(("doc_id", "paragraph", "start", "stop", "family", "probability", "similarity"), map(list, cols), strict=True))

    return map_text(spread(docs), id_col, text_col, fn, "doc_id long, paragraph long, start long, stop long, family string, probability double, similarity double")
