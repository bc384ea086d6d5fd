"""Licence scan: a trained classifier of paragraphs over sparse word n-grams.

Paragraphs are the lines of a text, and the stretches of consecutive non-blank lines that a template
runs over: the lines of a block are joined, without words that are only punctuation or comment marks,
and where half of a template's 3-grams stand together over several lines, those lines are one paragraph,
in place of the lines by themselves. A multinomial logistic regression over word 1- to 3-grams
tells the licence families and "unknown"; it is trained on the templates below, cut, reworded
and set in noise, against noise, look-alike sentences and background paragraphs drawn from counts over every line of the corpus.
A temperature and a least probability, both fitted on held-out variants, make the class
"unknown" a calibrated one. A prediction is confirmed if enough of a template's 3-grams stand in
the paragraph, and of the words that only its family has.

A line is only evaluated if it holds a pair of words that stands in a template and not in one background line of
``COMMON`` or more ("of the"). More than half of each template's pairs are such, so a line that can be confirmed always is; all
others are "unknown" by rule and cost one lookup per word.

Training is deterministic and needs no label table. Its background is counted in one pass over all lines of all rows: how many
lines hold each n-gram of the templates and look-alikes, with and without those lines that hold a template. Other
n-grams are not in the model, so the counts are as long as its vocabulary, whatever the corpus.

Defined results: null and empty texts have no paragraphs; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored. Very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textkit import grams, mix64, of_texts, pieces
from lumenlake.plans.ship import ship

#: Notices and characteristic sentences of each licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The MIT License (MIT)",
        "Distributed under the terms of the MIT License.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License, Version 2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "the GNU General Public License, version 2",
        "the GNU General Public License, version 3",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "the GNU Lesser General Public License, version 2.1",
        "the GNU Lesser General Public License, version 3",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "the BSD 3-Clause License",
        "the BSD 2-Clause License",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "the Mozilla Public License, version 2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution license.",
        "the Creative Commons Attribution 4.0 International Public License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under the Attribution-NonCommercial license.",
        "the Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Identifiers that follow "SPDX-License-Identifier:".
IDENTIFIERS = {
    "MIT": ("MIT", "MIT-0"),
    "Apache-2.0": ("Apache-2.0",),
    "GPL": ("GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL": ("MPL-1.1", "MPL-2.0"),
    "CC-BY": ("CC-BY-3.0", "CC-BY-4.0"),
    "CC-BY-NC": ("CC-BY-NC-3.0", "CC-BY-NC-4.0"),
    "ISC": ("ISC",),
    "Unlicense": ("Unlicense",),
}
#: Notices of licences that are none of the families. Those of ``HELD_OUT`` are not trained on: they calibrate "unknown".
OTHERS = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Distributed under the Boost Software License, Version 1.0.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: CC0-1.0",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX-License-Identifier: CC-BY-SA-4.0",
)
HELD_OUT = (
    "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License version 2.0.",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL.",
    "Licensed under the Academic Free License version 3.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This code is licensed under the Microsoft Public License.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: EUPL-1.2",
)
#: Sentences near to licences that name none of them.
LOOKALIKES = (
    "All rights reserved.",
    "The driving license must be renewed every ten years at the public office.",
    "Use of this site is subject to the terms of service and the privacy policy.",
    "He was granted permission to use the material free of charge.",
    "The warranty does not apply to damage in transit; see the conditions of sale.",
    "The software is distributed to all customers with the next version.",
    "A copy of this notice was published by the foundation last year.",
    "This work was released to the public in many copies and is now out of print.",
)
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
SPDX = "SPDX-License-Identifier:"


def notices(family: str) -> list[str]:
    """Everything that names a family: its templates, and its identifiers."""
    return [*TEMPLATES[family], *[f"{SPDX} {x}" for x in IDENTIFIERS[family]]]


#: First words of comment lines that hold letters.
MARKS = ("dnl", "rem", "c")
#: Background paragraphs made by the counts, length of the list of noise words; variants of a template; steps of training.
DRAWN, NOISE, VARIANTS, STEPS, RIDGE = 2_000, 20_000, 60, 150, 1e-3
CONFIRMED, LEAST_PRECISION, COMMON = 0.5, 0.99, 200
_LUT = 1 << 18


@dataclass
class Classifier:
    known: np.ndarray
    weight: np.ndarray  # len(known) x families
    bias: np.ndarray
    temperature: float
    least: float
    templates: dict[str, list[np.ndarray]]
    own: dict[str, list[np.ndarray]]  # of each template the words that no other family's have
    pairs: np.ndarray  # telling pairs of words, of which a line must have one

    def telling(self, h: np.ndarray) -> np.ndarray:
        """Which of the pairs of words tell of a template."""
        if not hasattr(self, "_pair"):
            self._pair = np.zeros(_LUT, bool)
            self._pair[(self.pairs & np.uint64(_LUT - 1)).astype(np.int64)] = True
        out = self._pair[(h & np.uint64(_LUT - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, h[at]), len(self.pairs) - 1)] == h[at]
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_seen"):
            self._seen = np.zeros(_LUT, bool)
            self._seen[(self.known & np.uint64(_LUT - 1)).astype(np.int64)] = True
        out = np.full(len(h), -1)
        at = np.flatnonzero(self._seen[(h & np.uint64(_LUT - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = np.where(self.known[k] == h[at], k, -1)
        return out

    def in_templates(self, g: np.ndarray) -> np.ndarray:
        """Which of the 3-grams stand in any template."""
        if not hasattr(self, "_threes"):
            self._threes = np.unique(np.concatenate([t for ts in self.templates.values() for t in ts]))
            self._has = np.zeros(_LUT, bool)
            self._has[(self._threes & np.uint64(_LUT - 1)).astype(np.int64)] = True
        out = self._has[(g & np.uint64(_LUT - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        k = np.minimum(np.searchsorted(self._threes, g[at]), len(self._threes) - 1)
        out[at] = self._threes[k] == g[at]
        return out

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        z = np.stack([self.weight[f].sum(0) / np.sqrt(max(1, len(f))) for f in features]) + self.bias if features else np.empty((0, len(FAMILIES)))
        return softmax(z / self.temperature)

    def decide(self, features: list[np.ndarray], threes: list[np.ndarray | Callable[[], np.ndarray]]) -> list[tuple[str, float, float]]:
        """Family, its probability and the share of its best template that stands in the paragraph, whose grams may come from a function."""
        out = []
        for p, g in zip(self.probabilities(features), threes):
            k = int(p.argmax())
            if FAMILIES[k] == UNKNOWN or p[k] < self.least:
                out.append((UNKNOWN, float(p[-1]), 0.0))
            else:
                g = g() if callable(g) else g
                share = [float(np.isin(t, g).mean()) if not len(own) or np.isin(own, g).mean() >= CONFIRMED else 0.0 for t, own in zip(self.templates[FAMILIES[k]], self.own[FAMILIES[k]])]
                out.append((FAMILIES[k], float(p[k]), max(share)))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bare(p) -> None:
    """Words without ASCII punctuation at their ends."""
    for _ in range(3):
        p.start += (p.end - p.start > 1) & _EDGE[p.data[p.start]]
        p.end -= (p.end - p.start > 1) & _EDGE[p.data[p.end - 1]]


_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _numbered(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of 1-, 2- and 3-grams of a stretch of words."""
    return [mix64(h + np.uint64(1)), grams(h, 2), grams(h, 3)]


def _words(text: str) -> np.ndarray:
    p = of_texts([text])
    _bare(p)
    return p.hashes(fold=True)


def features_of(text: str) -> np.ndarray:
    return np.unique(np.concatenate(_numbered(_words(text))))


def template_grams(h: np.ndarray) -> np.ndarray:
    """What a template is compared by: its 3-grams, or its 2-gram where it has two words."""
    return grams(h, 3) if len(h) > 2 else grams(h, 2)


def threes_of(text: str) -> np.ndarray:
    """Distinct grams by which a template is compared."""
    return np.unique(template_grams(_words(text)))


def compared(h: np.ndarray) -> np.ndarray:
    """The grams and words of a paragraph that templates are looked for in."""
    return np.unique(np.concatenate([grams(h, 3), grams(h, 2), mix64(h + np.uint64(1))]))


def variants(rng: np.random.Generator, noise: list[str], n: int, others: tuple[str, ...] = OTHERS) -> tuple[list[str], list[int]]:
    """Training paragraphs: templates cut, with words lost and noise around; other licences, look-alikes and noise as unknown."""
    texts, labels, noise = [], [], np.array(noise)
    words = lambda k: [str(w) for w in rng.choice(noise, k)] if k else []

    def add(template: str, label: int, n: int) -> None:
        full = template.split()
        for v in range(n):
            w = [x for x in full if rng.random() > 0.06 * (v % 3)] if len(full) > 3 else full
            if len(w) > 12 and v % 2:
                a = int(rng.integers(0, len(w) // 3))
                w = w[a : a + max(10, int(len(w) * 0.6))]
            texts.append(" ".join([*words(int(rng.integers(0, 12)) if v % 4 else 0), *w, *words(int(rng.integers(0, 12)) if v % 4 else 0)]))
            labels.append(label)

    for k, family in enumerate(TEMPLATES):
        for template in notices(family):
            add(template, k, n if len(template.split()) > 3 else n // 4)
    for template in others:
        add(template, len(FAMILIES) - 1, n)
    for v in range(n * 12):
        look = str(rng.choice(LOOKALIKES)).split() if v % 2 else []
        texts.append(" ".join([*words(int(rng.integers(3, 30))), *look, *words(int(rng.integers(0, 20)))]))
        labels.append(len(FAMILIES) - 1)
    return texts, labels


@dataclass
class Background:
    """Counts over all lines that have words, by feature of the vocabulary; iterated, it gives noise words."""

    known: np.ndarray
    lines: int
    clean: int  # lines that hold no template
    words: int
    seen: np.ndarray  # lines with each feature
    seen_clean: np.ndarray  # of those the clean ones
    times: np.ndarray  # how often each word of the vocabulary stands in any line

    def __iter__(self) -> Iterator[str]:
        """``NOISE`` words as often as the corpus has them, without those of templates; a word that is in no training text is as good as any other."""
        bare = lambda ts: {w.strip(".,;:()\"").lower() for t in ts for w in t.split()}
        count = lambda w: int(self.times[np.searchsorted(self.known, mix64(_words(w) + np.uint64(1)))].sum())
        own = bare(t for f in TEMPLATES for t in notices(f))
        rest = max(1, self.words - sum(map(count, sorted(own - {""}))))
        out = [w for w in sorted(bare(OTHERS) - own - {""}) for _ in range(round(NOISE * min(1.0, count(w) / rest)))][:NOISE]
        yield from out
        yield from (f"zq{k}x" for k in range(NOISE - len(out)))

    def draw(self, rng: np.random.Generator, n: int) -> list[np.ndarray]:
        """Features of ``n`` clean paragraphs, each feature as likely as in a clean line of the corpus."""
        return [np.flatnonzero(rng.random(len(self.known)) * self.clean < self.seen_clean) for _ in range(n if self.clean else 0)]


def blank() -> Classifier:
    """The classifier before training: its vocabulary, templates and their own words."""
    said = {f: notices(f) for f in TEMPLATES}
    vocabulary = np.unique(np.concatenate([features_of(t) for ts in (*said.values(), LOOKALIKES, OTHERS) for t in ts]))
    templates = {f: [threes_of(t) for t in ts] for f, ts in said.items()}
    return Classifier(vocabulary, np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, 0.5, templates, _own_words(said), np.empty(0, np.uint64))


def train(background: Background, seed: int = 11) -> Classifier:
    """A classifier from the templates and the counts of the background."""
    rng = np.random.default_rng(seed)
    model = blank()
    noise = [*background, *(w for t in LOOKALIKES for w in t.split())]
    model.pairs = _telling([t for f in TEMPLATES for t in notices(f)], background)

    def matrix(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            f = model.find(features_of(t))
            out.append(f[f >= 0])
        return out

    texts, labels = variants(rng, noise, VARIANTS)
    drawn = background.draw(rng, DRAWN)
    x, y = matrix(texts) + drawn, np.array(labels + [len(FAMILIES) - 1] * len(drawn))
    # The features are sparse, but the templates' vocabulary is small, so a full matrix is the faster one.
    size = np.array([max(1, len(f)) for f in x])
    full = np.zeros((len(x), len(model.known)), np.float32)
    full[np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate(x)] = np.repeat(1 / np.sqrt(size), [len(f) for f in x])
    truth = np.eye(len(FAMILIES), dtype=np.float32)[y]
    share = (1 / np.maximum(1, np.bincount(y, minlength=len(FAMILIES))))[y][:, None].astype(np.float32)
    m, v = np.zeros_like(model.weight), np.zeros_like(model.weight)
    for step in range(1, STEPS + 1):
        miss = (softmax(full @ model.weight.astype(np.float32) + model.bias) - truth) * share
        g = full.T @ miss.astype(np.float32) + RIDGE * model.weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weight -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.bias -= 0.1 * miss.sum(0)
    held, truth = variants(rng, noise, 12, HELD_OUT)
    return calibrate(model, matrix(held), np.array(truth))


def _own_words(said: dict[str, list[str]]) -> dict[str, list[np.ndarray]]:
    """Of each template its words that stand in no other family's, nor in those of other licences."""
    words = lambda t: np.unique(mix64(_words(t) + np.uint64(1)))
    of = {f: [words(t) for t in ts] for f, ts in said.items()}
    rest = {f: np.concatenate([w for g in of for w in of[g] if g != f] + [words(t) for t in (*OTHERS, *LOOKALIKES)]) for f in of}
    return {f: [w[~np.isin(w, rest[f])] for w in ws] for f, ws in of.items()}


def _telling(texts: list[str], background: Background) -> np.ndarray:
    """Pairs of words of templates without those that stand in many background lines, but all pairs of a template that would keep too few."""
    pairs = lambda t: np.unique(grams(_words(t), 2))
    common = background.known[background.seen > max(3, background.lines // COMMON)]
    out = []
    for t in texts:
        own = pairs(t)
        rare = own[~np.isin(own, common)]
        out.append(rare if 2 * len(rare) > len(own) + 2 or len(rare) == len(own) else own)
    return np.unique(np.concatenate(out))


def calibrate(model: Classifier, x: list[np.ndarray], y: np.ndarray) -> Classifier:
    """Temperature of least log loss; then the least probability at which predictions of a family are right often enough."""
    losses = []
    grid = np.geomspace(0.2, 5, 24)
    for t in grid:
        model.temperature = float(t)
        losses.append(-np.log(model.probabilities(x)[np.arange(len(y)), y] + 1e-12).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(x)
    top, best = p.argmax(1), p.max(1)
    named = top < len(FAMILIES) - 1
    model.least = 0.99
    for cut in np.linspace(0.3, 0.99, 70):
        chosen = named & (best >= cut)
        if chosen.any() and (top == y)[chosen].mean() >= LEAST_PRECISION:
            model.least = float(cut)
            break
    return model


def stretches(model: Classifier, g: np.ndarray, at: np.ndarray) -> list[tuple[float, int, int]]:
    """(share, first, last) of the places where enough of a template's 3-grams stand together; ``g`` at places ``at``, ascending."""
    out = []
    for template in (t for ts in model.templates.values() for t in ts):
        mine = np.flatnonzero(np.isin(g, template))
        need = CONFIRMED * len(template)
        if len(mine) < need:
            continue
        run: dict[int, int] = {}  # 3-gram and its place
        for k in [*mine.tolist(), -1]:
            old = list(run.values())[-1] if run else 0
            # A stretch ends at a gap as long as the template, or where the template begins anew.
            if run and (k < 0 or at[k] - old > len(template) or (int(g[k]) in run and len(run) >= need)):
                if len(run) >= need:
                    out.append((len(run) / len(template), min(run.values()), old))
                run = {}
            if k >= 0:
                run.pop(int(g[k]), None)
                run[int(g[k])] = int(at[k])
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def in_line(model: Classifier, h: np.ndarray) -> list[tuple[int, int, str, float, float]]:
    """(first word, end word, family, probability, share) of a line: of the whole of it, or of each stretch that names another family."""

    def said(a: int, b: int) -> tuple[str, float, float]:
        f = np.concatenate([model.find(np.unique(x)) for x in _numbered(h[a:b])])
        return model.decide([f[f >= 0]], [lambda: compared(h[a:b])])[0]

    whole = said(0, len(h))
    parts: list[tuple[int, int, str, float, float]] = []
    for n in (3, 2):
        g = grams(h, n)
        at = np.flatnonzero(model.in_templates(g))
        for _, first, last in stretches(model, g[at], at) if len(at) > n - 2 else []:  # a template has two 3-grams or one 2-gram
            a, b = first, last + n
            if not any(a < y and x < b for x, y, *_ in parts):
                found = said(a, b)
                if found[0] != UNKNOWN and found[2] >= CONFIRMED:
                    parts.append((a, b, *found))
    if len({x[2] for x in parts}) > 1:
        return sorted(parts)
    return [] if whole[0] == UNKNOWN else [(0, len(h), *whole)]


def joined(model: Classifier, h: np.ndarray, line: np.ndarray, block: np.ndarray) -> list[tuple[int, int, str, float, float]]:
    """(first word, end word, family, probability, share) of paragraphs over several lines of a block.

    ``h`` hashes the words, ``line`` and ``block`` number their lines and blocks, ascending.
    """
    g = grams(h, 3)
    if not len(g):
        return []
    at = np.flatnonzero(model.in_templates(g) & (block[:-2] == block[2:]))
    out = []
    for a, b in zip(*_runs(block[at])):
        places = at[a:b]
        if b - a < 2 or line[places[0]] == line[places[-1] + 2]:
            continue
        taken: list[tuple[int, int]] = []
        for _, first, last in stretches(model, g[places], places):
            lo, hi = int(np.searchsorted(line, line[first], "left")), int(np.searchsorted(line, line[last + 2], "right"))
            if any(lo < y and x < hi for x, y in taken):
                continue
            if line[first] == line[last + 2]:
                taken.append((lo, hi))
                continue
            f = np.concatenate([model.find(np.unique(x)) for x in _numbered(h[lo:hi])])
            (family, prob, share), = model.decide([f[f >= 0]], [lambda: compared(h[lo:hi])])
            if family != UNKNOWN and share >= CONFIRMED:
                taken.append((lo, hi))
                out.append((lo, hi, family, prob, share))
    return out


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of runs of equal values."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return [0, *cut.tolist()] if len(x) else [], [*cut.tolist(), len(x)] if len(x) else []


def line_counts(model: Classifier, p) -> np.ndarray:
    """Of a piece, rows ``seen``, ``seen_clean`` and ``times`` of ``Background``; the last column has the lines, the clean lines and the words."""
    size = len(model.known)
    out = np.zeros((3, size + 1), np.int64)
    line, text = np.cumsum(p.data == 10)[p.start] if len(p.start) else np.empty(0, np.int64), np.repeat(np.arange(len(p)), p.words_in())
    _bare(p)
    h = p.hashes(fold=True)
    if not len(h):
        return out
    unit = np.cumsum(np.concatenate([[False], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
    held = []
    for k, g in enumerate(_numbered(h)):
        f = model.find(g)
        at = np.flatnonzero((f >= 0) & (unit[: len(g)] == unit[k : k + len(g)]))
        held.append(unit[at] * size + f[at])
        if k == 0:
            out[2, :size] = np.bincount(f[at], minlength=size)
    of, feature = np.divmod(np.unique(np.concatenate(held)), size)
    # Lines of which a template has enough 3-grams.
    every = [t for ts in model.templates.values() for t in ts if len(t)]
    in_template = np.stack([np.isin(model.known, t) for t in every], 1)
    near = np.flatnonzero(in_template.any(1)[feature])
    units, row = np.unique(of[near], return_inverse=True)
    share = np.zeros((len(units), len(every)), np.int64)
    np.add.at(share, row, in_template[feature[near]])
    held_by = units[(share >= CONFIRMED * np.array([len(t) for t in every])).any(1)]
    out[0, :size] = np.bincount(feature, minlength=size)
    out[1, :size] = np.bincount(feature[~np.isin(of, held_by)], minlength=size)
    lines = int(unit[-1]) + 1
    out[:, size] = lines, lines - len(held_by), len(h)
    return out


def background_of(docs: DataFrame, text_col: str = "text") -> Background:
    """Counts over every line of every row: one pass, and a row of counts a task."""
    ship(docs.sparkSession)
    model = blank()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(model.known) + 1), np.int64)
        for batch in batches:
            for p in pieces(batch.column(0)):
                total += line_counts(model, p)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in total], ["seen", "clean", "times"])

    counted = docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(count, "seen array<long>, clean array<long>, times array<long>")
    each = counted.select(F.posexplode(F.arrays_zip("seen", "clean", "times")).alias("k", "n"))
    sums = {r["k"]: r for r in each.groupBy("k").agg(*[F.sum(f"n.{c}").alias(c) for c in ("seen", "clean", "times")]).collect()}
    zero = {"seen": 0, "clean": 0, "times": 0}
    seen, clean, times = (np.array([sums.get(k, zero)[c] for k in range(len(model.known) + 1)], np.int64) for c in zero)
    return Background(model.known, int(seen[-1]), int(clean[-1]), int(times[-1]), seen[:-1], clean[:-1], times[:-1])


def _over_lines(model: Classifier, p, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, line: np.ndarray) -> list[tuple[int, int, int, str, float, float]]:
    """(text, first word, last word, family, probability, share) of paragraphs over several lines of a piece."""
    if len(h) < 3:
        return []
    solid = np.concatenate([[0], np.cumsum(~_EDGE[p.data])])
    text = np.repeat(np.arange(len(p)), p.words_in())
    fresh = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
    mark = of_texts([" ".join(MARKS)]).hashes(fold=True)
    kept = np.flatnonzero((solid[ends] > solid[starts]) & ~(fresh & np.isin(h, mark)))
    if len(kept) < 3:
        return []
    own_line, own_text = np.cumsum(fresh)[kept], text[kept]
    block = np.cumsum(np.concatenate([[False], (np.diff(line[kept]) > 1) | (np.diff(own_text) > 0)]))
    return [(int(own_text[a]), int(kept[a]), int(kept[b - 1]), *said) for a, b, *said in joined(model, h[kept], own_line, block)]


FOUND = "array<struct<start:int,end:int,family:string,p:double,template:double,confirmed:boolean>>"


def scanner(model: Classifier):
    """An Arrow UDF from text to the licence paragraphs in it; offsets in code points, end exclusive."""

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list[list[tuple]] = []
            for p in pieces(texts):
                own: list[list[tuple]] = [[] for _ in range(len(p))]
                rows.extend(own)
                line = np.cumsum(p.data == 10)
                para = line[p.start] if len(p.start) else np.empty(0, np.int64)
                starts, ends = p.start.copy(), p.end.copy()
                _bare(p)
                h = p.hashes(fold=True)
                many = _over_lines(model, p, starts, ends, h, para)
                two = model.telling(grams(h, 2))
                chars = None
                done = -1
                for w in np.flatnonzero(two).tolist():
                    i = int(np.searchsorted(p.word_at, w, "right")) - 1
                    lo, hi = int(p.word_at[i]), int(p.word_at[i + 1])
                    if w < done or w + 1 >= hi or para[w] != para[w + 1]:
                        continue
                    a = max(lo, int(np.searchsorted(para, para[w], "left")))
                    b = done = min(hi, int(np.searchsorted(para, para[w], "right")))
                    for x, y, family, prob, share in in_line(model, h[a:b]):
                        chars = np.concatenate([[0], np.cumsum((p.data & 0xC0) != 0x80)]) if chars is None else chars
                        base = chars[p.offsets[i]]
                        own[i].append((int(chars[starts[a + x]] - base), int(chars[ends[a + y - 1]] - base), family, prob, share, share >= CONFIRMED))
                for i, a, b, family, prob, share in many:
                    chars = np.concatenate([[0], np.cumsum((p.data & 0xC0) != 0x80)]) if chars is None else chars
                    base = chars[p.offsets[i]]
                    first, last = int(chars[starts[a]] - base), int(chars[ends[b]] - base)
                    inside = [x for x in own[i] if x[0] < last and first < x[1]]
                    # A line that is surely another family's stays as it is, and so does what stands around it.
                    if not any(x[5] and x[2] != family for x in inside):
                        own[i][:] = sorted([*(x for x in own[i] if x not in inside), (first, last, family, prob, share, True)])
            flat = [x for r in rows for x in r]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            struct = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate(kinds)], ["start", "end", "family", "p", "template", "confirmed"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), struct)

    return scan


def scan_licenses(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``found`` (FOUND) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    return rows.select(F.col("id_").alias(id_col), scanner(model)("text_").alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        id_col,
        F.size(sure).cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
    )
